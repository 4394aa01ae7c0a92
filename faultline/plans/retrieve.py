"""A table of queries to their closest past cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import search
from faultline.operators.case_index import CaseIndex
from faultline.operators.cases import expand_case


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    cases: DataFrame,
    k: int = rules.TOP_K_CASES,
    multiplier: int = rules.CANDIDATE_MULTIPLIER,
    metric: str = "l2",
    index: CaseIndex | None = None,
) -> DataFrame:
    """Up to ``k`` whole cases per query, best first.

    ``chunks`` has ``chunk_id, incident_id, embedding``.  An empty store gives an
    empty result of the same shape.  With ``index`` the cases come from it and only
    the buckets of the asked ids are read; ``cases`` is then not used.
    """
    ranked = matched_chunks(queries, chunks, k, multiplier, metric)
    top = search.top_cases(search.unique_cases(ranked, "case_id"), k)
    spread = F.xxhash64("query_id", "case_id")
    if index is not None:
        return expand_case(index.lookup(top, spread))
    return expand_case(search.lookup_cases(cases, top, spread))


def matched_chunks(
    queries: DataFrame, chunks: DataFrame, k: int, multiplier: int, metric: str = "l2"
) -> DataFrame:
    """Ranked hits with the case they belong to."""
    hits = search.nearest(queries, chunks, search.candidate_count(k, multiplier), metric)
    return search.candidates(hits, k, multiplier)
