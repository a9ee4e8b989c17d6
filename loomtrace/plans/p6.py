"""Problem 6: hierarchies of entries within sessions and of sessions among themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalized
from ..operators.hierarchy import ancestors, hierarchy, link_states, paths, spans
from ..tables import Tables, latest_by


def entry_links(t: Tables) -> DataFrame:
    """The current row of each entry: session_id, entry_id, parent_id."""
    return latest_by(t.entries, ["session_id", "entry_id"], "ingested_at", ["parent_id"])


def session_links(t: Tables) -> DataFrame:
    """session_id, parent of the current header of each session: a parent_session that is no session id is taken
    as a file path and resolved to the session with that file; what resolves to nothing stays as it stands."""
    s = latest_by(t.sessions.filter("session_id IS NOT NULL"), ["session_id"], "ingested_at", ["parent_session", "file_path"])
    s = s.withColumn("want", F.when(F.trim("parent_session") != "", F.trim("parent_session")))
    ids = s.select(F.col("session_id").alias("want"), F.lit(True).alias("is_id"))
    files = s.filter("file_path IS NOT NULL").groupBy(normalized(F.col("file_path")).alias("path")).agg(F.min("session_id").alias("by_path"))
    s = s.join(ids, "want", "left").withColumn("path", normalized(F.col("want"))).join(files, "path", "left")
    parent = F.when(F.col("is_id"), F.col("want")).otherwise(F.coalesce("by_path", "want"))
    return s.select("session_id", parent.alias("parent"))


def _both(t: Tables) -> list[tuple[str, DataFrame, tuple[str, str, str | None]]]:
    return [("entry", entry_links(t), ("entry_id", "parent_id", "session_id")), ("session", session_links(t), ("session_id", "parent", None))]


def _named(df: DataFrame, level: str) -> DataFrame:
    session, entry = (F.col("k"), F.col("v")) if level == "entry" else (F.col("v"), F.lit(""))
    return df.select(F.lit(level).alias("node_level"), session.alias("session_id"), entry.alias("entry_id"), *[c for c in df.columns if c not in ("k", "v")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    e, s = (_named(link_states(hierarchy(df, *by)), level) for level, df, by in _both(Tables(spark, folder)))
    return e.unionByName(s)


def p6_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    e, s = (_named(hierarchy(df, *by).select("k", "v", "root", "depth", "state"), level) for level, df, by in _both(Tables(spark, folder)))
    return e.unionByName(s)


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    e, s = (_named(paths(ancestors(df, *by)), level) for level, df, by in _both(Tables(spark, folder)))
    return e.unionByName(s)


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every node, as the stretch of places that they take in its tree."""
    e, s = (_named(spans(df, *by).withColumn("n_descendants", F.col("last") - F.col("pre")), level) for level, df, by in _both(Tables(spark, folder)))
    return e.unionByName(s)


QUERIES = {f.__name__: f for f in (p6_found, p6_hierarchy, p6_paths, p6_descendants)}

_NODES = r"""
WITH RECURSIVE cur_entries AS (
  SELECT session_id, entry_id, parent_id FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY ingested_at DESC, parent_id DESC NULLS LAST) AS rn FROM entries)
  WHERE rn = 1),
cur_sessions AS (
  SELECT session_id, parent_session, file_path FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ingested_at DESC, parent_session DESC NULLS LAST) AS rn FROM sessions)
  WHERE rn = 1),
wanted AS (
  SELECT session_id, nullif(trim(parent_session), '') AS want,
         regexp_replace(regexp_replace(regexp_replace(trim(parent_session), '/(\./)+', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '//+', '/', 'g') AS path
  FROM cur_sessions),
nodes AS (
  SELECT 'entry' AS node_level, session_id AS k, entry_id AS v, parent_id AS p FROM cur_entries
  UNION ALL
  SELECT 'session', '', w.session_id, CASE WHEN i.session_id IS NOT NULL THEN w.want ELSE coalesce(f.session_id, w.want) END
  FROM wanted w LEFT JOIN cur_sessions i ON i.session_id = w.want LEFT JOIN cur_sessions f ON f.file_path = w.path),
linked AS (
  SELECT n.*, n.p IS NOT NULL AND m.v IS NULL AS dead, CASE WHEN m.v IS NOT NULL THEN n.p END AS up
  FROM nodes n LEFT JOIN nodes m ON m.node_level = n.node_level AND m.k = n.k AND m.v = n.p),
"""
_WALK = r"""
down AS (
  SELECT node_level, k, v, v AS root, 0::BIGINT AS depth, v AS path FROM linked WHERE up IS NULL
  UNION ALL
  SELECT l.node_level, l.k, l.v, d.root, d.depth + 1, d.path || '/' || l.v
  FROM down d JOIN linked l ON l.node_level = d.node_level AND l.k = d.k AND l.up = d.v),
stuck AS (SELECT l.* FROM linked l ANTI JOIN down d ON d.node_level = l.node_level AND d.k = l.k AND d.v = l.v),
climb AS (
  SELECT node_level, k, v, up AS top, 1 AS far FROM stuck
  UNION ALL
  SELECT c.node_level, c.k, c.v, s.up, far + 1 FROM climb c JOIN stuck s ON s.node_level = c.node_level AND s.k = c.k AND s.v = c.top
  WHERE c.top <> c.v AND far < 200),
circle AS (SELECT DISTINCT node_level, k, v FROM climb WHERE top = v)
"""
_IDS = "CASE WHEN node_level = 'entry' THEN k ELSE v END AS session_id, CASE WHEN node_level = 'entry' THEN v ELSE '' END AS entry_id"

SQL = {
    "p6_found": _NODES + _WALK + f"""
SELECT node_level, {_IDS}, link_state FROM (
  SELECT s.node_level, s.k, s.v, CASE WHEN c.v IS NOT NULL THEN 'cycle' ELSE 'to_cycle' END AS link_state
  FROM stuck s LEFT JOIN circle c USING (node_level, k, v)
  UNION ALL SELECT node_level, k, v, 'dangling' FROM linked WHERE dead)""",
    "p6_paths": _NODES + _WALK + f"SELECT node_level, {_IDS}, path, depth FROM down",
    "p6_hierarchy": _NODES + _WALK + f"""
, top AS (SELECT node_level, k, v, min(t) AS root FROM (
  SELECT c.node_level, c.k, c.v, c.top AS t FROM climb c JOIN circle o ON o.node_level = c.node_level AND o.k = c.k AND o.v = c.top
  UNION ALL SELECT node_level, k, v, v FROM circle) GROUP BY ALL)
SELECT node_level, {_IDS}, root, depth, state FROM (
  SELECT node_level, k, v, root, depth, 'free' AS state FROM down
  UNION ALL SELECT t.node_level, t.k, t.v, t.root, NULL, CASE WHEN c.v IS NOT NULL THEN 'cycle' ELSE 'to_cycle' END FROM top t LEFT JOIN circle c USING (node_level, k, v))""",
    "p6_descendants": _NODES + _WALK + f"""
, steps AS (
  SELECT node_level, k, v, v AS root, [v] AS line FROM linked WHERE up IS NULL
  UNION ALL
  SELECT l.node_level, l.k, l.v, s.root, list_append(s.line, l.v) FROM steps s JOIN linked l ON l.node_level = s.node_level AND l.k = s.k AND l.up = s.v),
n AS (SELECT node_level, k, a AS v, count(*) - 1 AS n_descendants FROM (SELECT node_level, k, unnest(line) AS a FROM steps) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY node_level, k, root ORDER BY line) - 1 AS pre FROM steps)
SELECT node_level, {_IDS}, root, pre, pre + n_descendants AS last, n_descendants FROM o JOIN n USING (node_level, k, v)""",
}
