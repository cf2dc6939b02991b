"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: element starts, element ends and texts. The wrapper of a host is the expression that all its streams match:
elements, each around an expression of its own, text slots, optional items (x)? and repeated ones (x)+. It is found by alignment. Within a
page, neighbours that are alike, or that alternate, become one repeated item. A page is then laid against the wrapper, level by level: a
text that differs makes a slot variable, an item on one side only becomes optional, groups that repeat are merged. Wrappers of parts of
a host merge by the same alignment, in a tree, so a host of any size is reduced in parts and only wrappers travel.

The slots pick the text: every page is laid against its host's wrapper, and each of its texts is in or out by the slot that it falls into and by
whether the slot has this string on most pages. What an element says of itself is a prior.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.urls import split

#: Elements whose text is data, never shown.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head", "select", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that only mark words inside a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mi", "mo", "mn", "mrow", "msub", "msup", "ruby", "rt", "rp"}
#: Elements that are never main text; header only outside the article.
CHROME = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
#: Elements that close an open p.
BREAKS_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "dl", "table", "pre", "blockquote", "section", "article", "main", "nav", "footer", "aside", "header", "form", "hr", "figure", "fieldset", "address", "details"}
#: Words of class, id or role that name what is not main text.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|footer|foot|header|masthead|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|respond|disqus|replies|reply|pagination|pager|search|login|signup|toolbar|skip|copyright|contentinfo|complementary|navigation|alert|teaser)(?=$|[\s_\d-])",
    re.I,
)
#: Words among those that inside an article may name a part of it.
OF_ARTICLE = re.compile(r"(?:^|(?<=[\s_-]))(?:header|head|foot|side|search|alert|banner|widget|login|toolbar)(?=$|[\s_\d-])", re.I)
#: Of an article or main element only these words say that it isn't main text.
BOILER_MAIN = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teaser)(?=$|[\s_\d-])", re.I)
#: Names of a layout, not of what an element is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|has|no|without|is|layout|show|hide)[-_]\S*", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body)(?=$|[\s_\d-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WHITE = re.compile(r"\s+")
#: A string is template if over half of the pages of a wrapper of so many have it in one slot.
TEMPLATE_PAGES = 8
#: A slot counts its most frequent strings in so many counters; one that over N / COUNTERS of N strings are is among them.
COUNTERS = 64
#: So many wrappers of a host are merged in one go.
FAN_IN = 32


def _named(attrs: str) -> tuple[str, bool]:
    """Class, id and role as one string without digits; whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(attrs):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        kind = m[1].lower()
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif kind != "aria-hidden":
            names.append(value)
    return _WHITE.sub(" ", re.sub(r"\d+", "", " ".join(names))).strip().lower(), hidden


def _role(tag: str, names: str, hidden: bool, inside: str) -> str:
    """Role of an element in an element of role `inside`: body, content, drop."""
    if inside == "drop" or hidden or tag in CHROME or tag in RAW:
        return "drop"
    names = LAYOUT.sub("", names)
    if tag in MAIN:
        return "drop" if BOILER_MAIN.search(names) else "content"
    if tag == "header" and inside != "content" or names and tag not in ("body", "html") and BOILER.search(OF_ARTICLE.sub("", names) if inside == "content" else names):
        return "drop"
    if names and tag in ("div", "section", "td") and CONTENT.search(names):
        return "content"
    return inside


def tokens(page: str | None) -> list:
    """The stream of a page: a string for an element's start (its tag, names and role), 0 for its end, and [text, words, words in links] for a
    text, decoded, white space folded. Elements without text, and what names itself boilerplate, are left out.

    Tolerates unclosed and crossing elements, and a page that ends anywhere. Work and memory grow with the page, however deep it nests.
    """
    out: list = []
    stack: list[tuple[str, str]] = [("", "body")]  # tag, role
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if held:
            if stack[-1][1] != "drop":
                text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
                if text:
                    out.append([text, text.count(" ") + 1, linked])
            held.clear()
        linked = 0

    def pop() -> None:
        tag, role = stack.pop()
        opened[tag] -= 1
        if role != "drop":
            if isinstance(out[-1], str):
                out.pop()
            else:
                out.append(0)

    source, at = page or "", 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            held.append(text)
            if in_link:
                linked += len(text.split())
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        close, tag = (m[1] or "").lower(), (m[2] or "").lower()
        if close:
            if close == "a":
                in_link = False
            if close in INLINE:
                continue
            if close == "p" or opened[close]:
                flush()
                if opened[close]:
                    while stack[-1][0] != close:
                        pop()
                    pop()
        elif tag:
            attrs = m[3] or ""
            if tag == "a":
                in_link = True
            if tag in RAW - {"head"}:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                flush()
                at = end.end() if end else len(source)
                continue
            if tag in INLINE:
                names, hidden = _named(attrs) if attrs.strip() else ("", False)
                if hidden and tag not in VOID:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            flush()
            in_link = False
            if tag in VOID:
                continue
            if tag in BREAKS_P and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] in (tag, "p"):
                while len(stack) > 1 and stack[-1][0] in ("p", tag):
                    pop()
            if tag == "body":
                while len(stack) > 1:
                    pop()
            names, hidden = _named(attrs) if attrs.strip() else ("", False)
            if not attrs.rstrip().endswith("/"):
                role = _role(tag, names, hidden, stack[-1][1])
                stack.append((tag, role))
                opened[tag] += 1
                if role != "drop":
                    out.append(f"{tag}[{names}]{role}" if names else f"{tag} {role}")
    flush()
    while len(stack) > 1:
        pop()
    return out


class Item:
    """An element of an expression (label, and `items` around which it stands) or a text slot (label None)."""

    __slots__ = ("blocks", "first", "items", "label", "links", "optional", "pages", "repeated", "seen", "texts", "words")

    def __init__(self, label: str | None) -> None:
        self.label, self.first = label, ""  # first: the label of the first item that it was made with
        self.pages, self.optional, self.repeated = 1, False, False
        self.items: list[Item] = []
        self.texts: dict[int, int] = {}  # string's hash: pages that have it here, at least
        self.seen = self.words = self.links = 0  # seen: strings on all pages, alike ones of a page once
        self.blocks: list[int] = []  # of one page: which of its texts are here

    @property
    def key(self) -> tuple:
        """What is alike: elements of one name, and, without names, of one tag that begin alike."""
        return self.label, "" if self.label and "[" in self.label else self.first

    @property
    def role(self) -> str:
        return self.label[max(self.label.rfind("]"), self.label.rfind(" ")) + 1 :] if self.label else "body"


def pairs(x: list[Item], y: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """x and y aligned: elements that begin alike first, then, between those, elements alike in name."""
    kx, ky = [i.key for i in x], [i.key for i in y]
    if kx == ky:
        return list(zip(x, y, strict=True))
    out: list[tuple[Item | None, Item | None]] = []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, kx, ky, autojunk=False).get_opcodes():
        if kind == "equal":
            out += zip(x[i1:i2], y[j1:j2], strict=True)
            continue
        names = SequenceMatcher(None, [i.label or "" for i in x[i1:i2]], [j.label or "" for j in y[j1:j2]], autojunk=False)
        for same, a1, a2, b1, b2 in names.get_opcodes():
            if same == "equal":
                out += zip(x[i1 + a1 : i1 + a2], y[j1 + b1 : j1 + b2], strict=True)
            else:
                out += [(i, None) for i in x[i1 + a1 : i1 + a2]] + [(None, j) for j in y[j1 + b1 : j1 + b2]]
    return out


def _counted(a: dict[int, int], b: dict[int, int], same_page: bool) -> dict[int, int]:
    if same_page:
        a.update(b)  # in place: a page may have very many
        return a
    both = Counter(a)
    both.update(b)
    if len(both) <= COUNTERS:
        return dict(both)
    over = sorted(both.values(), reverse=True)[COUNTERS]
    return {h: c - over for h, c in both.items() if c > over}


def align(a: Item, b: Item, same_page: bool = False) -> Item:
    """Makes a match what either matches, and returns it; b is used up. same_page: both are parts of one page, which repeats them."""
    todo = deque([(a, b)])
    while todo:  # no recursion: pages nest without limit; first come, first served, so an item is complete before it is folded into its neighbour
        p, q = todo.popleft()
        p.repeated |= q.repeated
        p.optional |= q.optional
        if not same_page:
            p.pages += q.pages
        p.blocks += q.blocks
        p.words += q.words
        p.links += q.links
        new = sum(h not in p.texts for h in q.texts) if same_page else q.seen
        p.texts, p.seen = _counted(p.texts, q.texts, same_page), p.seen + new
        if p.items or q.items:
            merged = []
            for x, y in pairs(p.items, q.items):
                if x is not None and y is not None:
                    todo.append((x, y))
                else:
                    (x or y).optional = True
                merged.append(x or y)
            p.items = _tandems(_together(merged, todo), todo)
    return a


def _together(items: list[Item], todo: deque[tuple[Item, Item]]) -> list[Item]:
    """items with optional ones that are alike, which alignment left apart as their order varies, made one that repeats: an expression has no more items than kinds of them."""
    out, seen = [], {}
    for x in items:
        first = seen.get(x.key) if x.optional else None
        if first is None:
            if x.optional:
                seen[x.key] = x
            out.append(x)
        else:
            first.repeated = True
            todo.append((first, x))
    return out


def _tandems(items: list[Item], todo: deque[tuple[Item, Item]] | None = None) -> list[Item]:
    """items with runs of one, two or three that repeat made one repeated group; what is to be aligned for that goes to todo, or is done."""
    for n in (1, 2, 3):
        out: list[Item] = []
        k = 0
        while k < len(items):
            some = items[k : k + n]
            if len(out) >= n and len(some) == n and all(x.key == y.key for x, y in zip(out[-n:], some, strict=True)):
                for x, y in zip(out[-n:], some, strict=True):
                    x.repeated = True
                    if todo is None:
                        align(x, y, True)
                    else:
                        todo.append((x, y))
                k += n
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def expression(stream: list) -> Item:
    """The expression of one page: its stream as a tree, repeats folded."""
    root = Item("")
    stack, k = [root], 0
    for token in stream:
        if token == 0:
            done = stack.pop()
            done.first = done.items[0].label or "" if done.items else ""
            done.items = _tandems(done.items)
            stack[-1].items.append(done)
        elif isinstance(token, str):
            stack.append(Item(token))
        else:
            slot = Item(None)
            slot.texts, slot.seen, slot.words, slot.links, slot.blocks = {xxhash.xxh64_intdigest(token[0]): 1}, 1, token[1], token[2], [k]
            stack[-1].items.append(slot)
            k += 1
    root.items = _tandems(root.items)
    return root


def dump(root: Item) -> str:
    """An expression in prefix order, one list an item: depth, label, first, pages, optional, repeated; of slots also strings seen, words, linked words and counters."""
    out, todo = [], [(0, root)]
    while todo:
        depth, x = todo.pop()
        out.append([depth, x.label, x.first, x.pages, int(x.optional), int(x.repeated)] + ([x.seen, x.words, x.links, list(x.texts.items())] if x.label is None else []))
        todo += [(depth + 1, y) for y in reversed(x.items)]
    return json.dumps(out)


def load(text: str) -> Item:
    path: list[Item] = []
    for depth, label, first, pages, optional, repeated, *slot in json.loads(text):
        x = Item(label)
        x.first, x.pages, x.optional, x.repeated = first, pages, bool(optional), bool(repeated)
        if slot:
            x.seen, x.words, x.links = slot[:3]
            x.texts = dict(slot[3])
        del path[depth:]
        if path:
            path[-1].items.append(x)
        path.append(x)
    return path[0]


def decisions(wrapper: Item) -> str:
    """What a page needs to know of its host's wrapper, in prefix order: depth, label and first of elements; depth, 1 or 0, and template strings of slots.

    In a wrapper of TEMPLATE_PAGES pages a slot is variable if half of the pages that have it have a string of their own there; a
    variable slot that isn't mostly links is content, wherever it stands; one that isn't variable is content only in an element that says so, and
    strings that most pages share are template even there. With fewer pages, elements that name themselves content are that, and if none does, every slot is but link lists.
    """
    out, slots, todo = [], [], [(0, wrapper, "body")]
    many = wrapper.pages >= TEMPLATE_PAGES
    while todo:
        depth, x, inside = todo.pop()
        if x.label is not None:
            out.append([depth, x.label, x.first])
            todo += [(depth + 1, y, x.role if depth else "body") for y in reversed(x.items)]
            continue
        template = [h for h, c in x.texts.items() if many and 2 * c > wrapper.pages]
        own = x.seen - sum(x.texts[h] for h in template)
        row = [depth, 0, template]
        out.append(row)
        slots.append((row, inside, x.links * 2 > x.words, many and 2 * own > x.pages))
    named = any(inside == "content" for _, inside, _, _ in slots)
    for row, inside, linked, varies in slots:
        row[1] = int(inside == "content" or not linked and (varies or not named and not many))
    if not any(row[1] for row, _, _, _ in slots):
        for row, _, linked, _ in slots:
            row[1] = int(not linked)
    return json.dumps(out)


def known(text: str) -> Item:
    """decisions() as a tree to lay pages against; a slot's `seen` is whether it is content, its `texts` are template."""
    path = [Item("")]
    for depth, *told in json.loads(text)[1:]:
        x = Item(None if isinstance(told[0], int) else told[0])
        if x.label is None:
            x.seen, x.texts = told[0], dict.fromkeys(told[1], 1)
        else:
            x.first = told[1]
        del path[depth:]
        path[-1].items.append(x)
        path.append(x)
    return path[0]


def extract(stream: list, wrapper: Item) -> str:
    """Main text of a page, laid against its host's wrapper: the texts in content slots, without template strings. If that is nothing, with
    them; and if no slot is content, the elements that name themselves content, or, without names, all."""
    page = expression(stream)
    texts = [t[0] for t in stream if isinstance(t, list)]
    inner, outer, named, every = [], [], [], []
    todo = [(wrapper, page, "body")]
    while todo:
        w, p, inside = todo.pop()
        told = w.items if w is not None else []
        apart = {x.key: x for x in told}
        for x, y in pairs(told, p.items):
            if y is None:
                continue
            x = x or apart.get(y.key)  # elsewhere than in the expression
            if y.label is not None:
                todo.append((x, y, y.role))
                continue
            every += y.blocks
            if inside == "content":
                named += y.blocks
            if x is not None and x.seen:
                outer += y.blocks
                inner += [k for k in y.blocks if not x.texts or xxhash.xxh64_intdigest(texts[k]) not in x.texts]
            elif x is None and inside == "content":
                outer += y.blocks
                inner += y.blocks
    return "\n".join(texts[k] for k in sorted(inner or outer or named or every))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, stream as JSON), a few pages at a time."""
    names = ["page_id", "url", "host", "stream"]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            hosts = [split(u.as_py())[0].lower() for u in some.column("url")]
            made = [json.dumps(tokens(h.as_py()), ensure_ascii=False) for h in some.column("html")]
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(hosts, pa.string()), pa.array(made, pa.large_string()).cast(pa.string())], names=names)


def _dump(wrappers: dict[str, Item], part: int) -> pa.RecordBatch:
    columns = (list(wrappers), pa.string()), ([part] * len(wrappers), pa.int64()), ([dump(w) for w in wrappers.values()], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["host", "part", "wrapper"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of one partition, merged page by page; with very many hosts, more than one for some."""
    wrappers: dict[str, Item] = {}
    part = TaskContext.get().partitionId()
    for batch in batches:
        for host, stream in zip(batch.column("host").to_pylist(), batch.column("stream"), strict=True):
            own = expression(json.loads(stream.as_py()))
            wrappers[host] = align(wrappers[host], own) if host in wrappers else own
        if len(wrappers) > 50_000:
            yield _dump(wrappers, part)
            wrappers = {}
    yield _dump(wrappers, part)


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for one in sorted(frame["wrapper"]):
        whole = load(one) if whole is None else align(whole, load(one))
    return pd.DataFrame({"host": frame["host"].iloc[:1], "part": frame["part"].iloc[:1], "wrapper": [dump(whole)]})


def wrappers(streams: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, told: decisions) per host of streams (host, stream). Partial wrappers of a host are merged FAN_IN at a time, in a tree."""
    parts = written(streams.select("host", "stream").mapInArrow(_infer, "host string, part long, wrapper string"))
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        most //= FAN_IN
        merged = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("host", "part").applyInPandas(_merge, "host string, part long, wrapper string")
        if not most:
            break
        parts = written(merged)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decisions(load(w)) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("wrapper"), pa.array(found, pa.string())], names=["host", "wrapper", "told"])

    return merged.select("host", "wrapper").mapInArrow(told, "host string, wrapper string, told string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, Item] = {}
    names = ["page_id", "url", "text", "n_chars"]
    for batch in batches:
        texts = []
        for stream, told in zip(batch.column("stream"), batch.column("told"), strict=True):
            told = told.as_py()
            if told not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                parsed[told] = known(told)
            texts.append(extract(json.loads(stream.as_py()), parsed[told]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html; other columns are not read).

    Pages are parsed once, into a table of streams; wrappers are inferred from all streams, then every stream is laid against its host's. A
    null or empty html, or one of boilerplate only, has empty text; pages without a host are a host of their own; repeated rows are
    extracted each; very long and very deep pages are read whole. The table of decisions has a row a host and is written first, so the
    planner knows its size: small, it is broadcast and streams are not shuffled; else the join is a shuffle that splits a hot host.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    streams = written(rows.mapInArrow(_streams, "page_id long, url string, host string, stream string"))
    told = written(wrappers(streams).select(F.col("host").alias("_tm_host"), "told"))
    both = streams.join(told, F.col("host") == F.col("_tm_host")).select("page_id", "url", "stream", "told")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_text() of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
