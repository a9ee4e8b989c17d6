"""Problem 1: fragments split at natural boundaries to the limits of their kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables
from .splitting import read_options, split_oversized

_KEYS = ["session_id", "fragment_id"]


def _pieces(spark: SparkSession, folder: str, only: bool) -> DataFrame:
    t = Tables(spark, folder)
    return split_oversized(t.fragments, _KEYS, "frag_text", "semantic_kind", read_options(t.projector_options), only)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True).filter("piece_no = 0 AND n_pieces > 1").select(*_KEYS).distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of the fragments over their limits."""
    return _pieces(spark, folder, True)


def p1_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every fragment as pieces within its limit."""
    return _pieces(spark, folder, False)


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized texts put together again from their pieces: the round trip."""
    p = _pieces(spark, folder, True)
    own = F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("t"))
    g = p.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(own)).alias("p"))
    return g.select(*_KEYS, F.concat_ws("", F.transform("p", lambda x: x["t"])).alias("frag_text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_all, p1_rejoined)}
_OVER = """
FROM (SELECT DISTINCT session_id, fragment_id, semantic_kind, frag_text FROM fragments) f
LEFT JOIN projector_options o ON o.semantic_kind = f.semantic_kind
WHERE length(f.frag_text) > coalesce(o.max_indexed_text_chars, (SELECT max_indexed_text_chars FROM projector_options WHERE semantic_kind IS NULL))"""
SQL = {"p1_found": "SELECT DISTINCT f.session_id, f.fragment_id" + _OVER, "p1_rejoined": "SELECT f.session_id, f.fragment_id, f.frag_text" + _OVER}
