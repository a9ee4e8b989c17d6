"""Queries of incremental maintenance over observed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain
from ..tables import Tables, latest_by

_COLUMNS = ["session_id", "size_bytes", "mtime_ms", "entry_count", "entry_hashes", "header_hash"]


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Observations of each file: in the last run, and the latest in an earlier one that ended well."""
    t = Tables(spark, folder)
    o = latest_by(t.source_obs.filter("file_path IS NOT NULL"), ["run_id", "file_path"], "observed_at", _COLUMNS)
    last = t.index_runs.agg(F.max("run_id").alias("run_id"))
    now = o.join(last, "run_id", "left_semi").drop("run_id")
    ok = t.index_runs.filter("run_state = 'ok'").join(last, "run_id", "left_anti").select("run_id")
    before = latest_by(o.join(ok, "run_id", "left_semi"), ["file_path"], "run_id", _COLUMNS)
    return now, before


def incremental_decision(spark: SparkSession, folder: str) -> DataFrame:
    now, before = _runs(spark, folder)
    x = F.struct("header_hash", "entry_count", "entry_hashes")
    d = now.select("file_path", x.alias("current")).join(before.select("file_path", x.alias("previous")), "file_path", "left")
    return d.select("file_path", maintain.decision(F.col("previous"), F.col("current")).alias("decision"))


def unchanged_sources(spark: SparkSession, folder: str) -> DataFrame:
    now, before = _runs(spark, folder)
    return maintain.unchanged(before, now)


def removed_sources(spark: SparkSession, folder: str) -> DataFrame:
    now, before = _runs(spark, folder)
    return maintain.removed(before, now)


def budget_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The newest files that a start reads within its default budget of files and a twentieth of its bytes."""
    now, _ = _runs(spark, folder)
    return maintain.select_within(now, maintain.START_FILES, maintain.START_BYTES // 20)[0]


def coverage_receipt(spark: SparkSession, folder: str) -> DataFrame:
    now, _ = _runs(spark, folder)
    c = maintain.select_within(now, maintain.START_FILES, maintain.START_BYTES // 20)[1]
    row = (c.files, c.bytes, c.selected_files, c.selected_bytes, c.files - c.selected_files, c.bytes - c.selected_bytes, c.limited)
    return spark.createDataFrame([row], "files long, bytes long, selected_files long, selected_bytes long, skipped_files long, skipped_bytes long, limited boolean")


QUERIES = {f.__name__: f for f in (incremental_decision, unchanged_sources, removed_sources, budget_selection, coverage_receipt)}
_RUNS = """
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, file_path ORDER BY observed_at DESC) AS rn FROM source_obs WHERE file_path IS NOT NULL) WHERE rn = 1),
now AS (SELECT * FROM o WHERE run_id = (SELECT max(run_id) FROM index_runs)),
before AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY file_path ORDER BY o.run_id DESC) AS r2 FROM o JOIN index_runs i ON i.run_id = o.run_id
  WHERE i.run_state = 'ok' AND o.run_id < (SELECT max(run_id) FROM index_runs)) WHERE r2 = 1)"""
_PICK = """
files AS (SELECT file_path, size_bytes, coalesce(mtime_ms, -4611686018427387904) AS mtime_ms, row_number() OVER (ORDER BY coalesce(mtime_ms, -4611686018427387904) DESC, file_path) AS i FROM now),
pick AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS n, 0::HUGEINT AS used, NULL::VARCHAR AS file_path
  UNION ALL
  SELECT f.i, p.n + (p.n < 100 AND f.size_bytes <= 1677721 - p.used)::INT, p.used + CASE WHEN p.n < 100 AND f.size_bytes <= 1677721 - p.used THEN f.size_bytes ELSE 0 END,
    CASE WHEN p.n < 100 AND f.size_bytes <= 1677721 - p.used THEN f.file_path END
  FROM pick p JOIN files f ON f.i = p.i + 1)"""
SQL = {
    "incremental_decision": f"""
WITH {_RUNS} SELECT n.file_path, CASE WHEN b.file_path IS NULL THEN 'new' WHEN b.header_hash IS DISTINCT FROM n.header_hash OR n.entry_count < b.entry_count THEN 'rebuild'
  WHEN b.entry_count = 0 THEN CASE WHEN n.entry_count = 0 THEN 'same' ELSE 'rebuild' END
  WHEN n.entry_hashes[1:b.entry_count] <> b.entry_hashes[1:b.entry_count] THEN 'rebuild' WHEN n.entry_count > b.entry_count THEN 'append' ELSE 'same' END AS decision
FROM now n LEFT JOIN before b ON b.file_path = n.file_path""",
    "unchanged_sources": f"WITH {_RUNS} SELECT n.file_path FROM now n JOIN before b ON b.file_path = n.file_path AND b.size_bytes = n.size_bytes AND b.mtime_ms = n.mtime_ms",
    "removed_sources": f"WITH {_RUNS} SELECT file_path FROM before WHERE file_path NOT IN (SELECT file_path FROM now)",
    "budget_selection": f"WITH RECURSIVE {_RUNS}, {_PICK} SELECT f.file_path, f.size_bytes, f.mtime_ms FROM pick p JOIN files f ON f.i = p.i WHERE p.file_path IS NOT NULL",
    "coverage_receipt": f"""
WITH RECURSIVE {_RUNS}, {_PICK}, a AS (SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files), z AS (SELECT max(n)::BIGINT AS selected_files, max(used)::BIGINT AS selected_bytes FROM pick)
SELECT files, bytes, selected_files, selected_bytes, files - selected_files AS skipped_files, bytes - selected_bytes AS skipped_bytes, selected_files <> files AS limited FROM a, z""",
}
