"""Problem 5: the entries that the current indexing run has to process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import pending_entries
from ..session import scratch
from ..tables import Tables


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return pending_entries(t.source_obs, t.index_runs, scratch(spark, "p5"))


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
WITH o AS (
  SELECT run_id, file_path, entry_hashes FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, file_path ORDER BY observed_at DESC) AS rn FROM source_obs)
  WHERE rn = 1),
now AS (SELECT o.* FROM o WHERE run_id = (SELECT max(run_id) FROM index_runs)),
done AS (
  SELECT file_path, entry_hashes FROM (
    SELECT o.*, row_number() OVER (PARTITION BY file_path ORDER BY o.run_id DESC) AS rn
    FROM o JOIN index_runs r ON r.run_id = o.run_id
    WHERE r.run_state = 'ok' AND o.run_id < (SELECT max(run_id) FROM index_runs))
  WHERE rn = 1),
places AS (SELECT file_path, entry_hashes, unnest(range(len(entry_hashes))) AS i FROM now)
SELECT p.file_path, p.i::INTEGER AS entry_no
FROM places p LEFT JOIN done d ON d.file_path = p.file_path
WHERE NOT coalesce(regexp_full_match(p.entry_hashes[p.i + 1], '[0-9a-f]{8}') AND p.entry_hashes[p.i + 1] = d.entry_hashes[p.i + 1], false)""",
}
