"""All queries of the engine by name, with their SQL for comparison."""

from lexloom.plans import lattice_queries, lexicon_queries, phrase_queries, source_queries, term_queries, text_queries  # noqa: F401
from lexloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
