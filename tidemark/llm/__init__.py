"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from tidemark.llm.embeddings import op6_embeddings
from tidemark.llm.html import op10_html
from tidemark.llm.licences import OP7_SQL, op7_licences
from tidemark.llm.mixing import op9_mixing
from tidemark.llm.packing import op1_packing
from tidemark.llm.quality import OP5_SQL, op5_quality
from tidemark.llm.secrets import op2_secrets
from tidemark.llm.simhash import op4_simhash
from tidemark.llm.sstable import op3_sstable
from tidemark.llm.urls import OP8_SQL, op8_urls

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_secrets, op3_sstable, op4_simhash, op5_quality, op6_embeddings, op7_licences, op8_urls, op9_mixing, op10_html)
}
ORACLE_SQL = {"op5_quality": OP5_SQL, "op7_licences": OP7_SQL, "op8_urls": OP8_SQL}
