"""All queries over the test tables, and the SQL that an independent engine answers them with."""

from tidemark.plans import build, calendar, careers, decisions, entities, evaluation, history, league, lists, pointintime, radar, rates, scalars
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "build", "calendar", "careers", "decisions", "entities", "evaluation", "history", "league", "lists", "pointintime", "radar", "rates", "scalars"]
