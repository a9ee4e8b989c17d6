"""Problem 2: drifting headers and entries in raw session lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalized
from ..operators import drift
from ..session import checkpointed
from ..tables import Tables


def _instant(c: Column) -> Column:
    """@milliseconds of a stamp in any of its forms (digits by their number), null if it is none."""
    n, size = c.try_cast("decimal(38,0)"), F.length(F.ltrim(c, F.lit("-")))
    ms = F.when(size <= 11, n * 1000).when(size <= 14, n).when(size <= 17, F.floor(n / 1000)).otherwise(F.floor(n / 1_000_000))
    digits = c.rlike("^-?[0-9]{1,19}$")
    return F.concat(F.lit("@"), F.when(digits, ms.cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(F.when(~digits, c)))).cast("string"))


def _forms(c: Column, stamp: bool) -> Column:
    return F.array_compact(F.array(c, _instant(c))) if stamp else F.array_compact(F.array(c))


def truths(t: Tables, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference values of headers (by file) and of entries (by session and entry id)."""
    files = lines.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.max("file_path").alias("file_path"))
    files = files.withColumn("path", normalized(F.col("file_path")))
    s = t.sessions.filter("session_id IS NOT NULL").select(normalized(F.col("file_path")).alias("path"), "session_id", "created_at", "cwd")
    each = F.explode(
        F.create_map(F.lit("sessionId"), _forms(F.col("session_id"), False), F.lit("createdAt"), _forms(F.col("created_at"), True), F.lit("cwd"), _forms(F.col("cwd"), False))
    )
    h = files.join(s.distinct(), "path").select("file_id", "session_id", each.alias("field_name", "truth")).distinct()
    of = F.create_map(F.lit("timestamp"), _forms(F.col("entry_ts"), True), F.lit("type"), _forms(F.col("entry_type"), False))
    e = t.entries.filter("session_id IS NOT NULL AND entry_id IS NOT NULL").select("session_id", F.col("entry_id").alias("ref"), of.alias("truths"))
    return h, e


def found_changes(t: Tables, only: Column | None = None) -> tuple[DataFrame, drift.Baseline]:
    """The changes of all versions, or of those whose profiled records only picks."""
    baseline = drift.read_baseline(t.baseline_fields)
    lines = t.raw_lines
    records = drift.profile(lines, baseline)
    records = checkpointed(records if only is None else records.filter(only))
    proof = drift.evidence(records, *truths(t, lines))
    return drift.changes(records, proof, baseline), baseline


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    c, _ = found_changes(Tables(spark, folder))
    return c.select("file_id", "record_kind", "field_name", "change_kind").distinct()


def _unified(spark: SparkSession, folder: str, kind: str, stamp: str) -> DataFrame:
    t = Tables(spark, folder)
    found, baseline = found_changes(t, F.col("record_kind") == kind)
    return drift.unify(t.raw_lines, baseline, found, kind, frozenset([stamp]))


def p2_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Every header in the baseline's columns."""
    return _unified(spark, folder, "header", "createdAt")


def p2_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry in the baseline's columns."""
    return _unified(spark, folder, "entry", "timestamp")


QUERIES = {f.__name__: f for f in (p2_found, p2_headers, p2_entries)}
SQL: dict[str, str] = {}
