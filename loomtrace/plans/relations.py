"""Queries of relationships, lineage and forks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_within
from ..operators import relations
from ..store import Store
from ..tables import Tables, latest_by
from .base import STATES, STORE, store


def _hashed(spark: SparkSession, folder: str) -> Store:
    """The store with the entry hashes of each file's latest observation."""
    s = store(spark, folder)
    o = latest_by(Tables(spark, folder).source_obs.filter("session_id IS NOT NULL").withColumn("at", F.struct("run_id", "observed_at")), ["session_id"], "at", ["entry_hashes"])
    s.hashes = o.select("session_id", F.posexplode("entry_hashes").alias("append_seq", "hash")).withColumn("append_seq", F.col("append_seq").cast("long"))
    return s


def tool_result_for(spark: SparkSession, folder: str) -> DataFrame:
    e = relations.tool_results(store(spark, folder))
    return e.select("session_id", "source_id", "target_id", "detail", "append_seq", "ord")


def file_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = store(spark, folder)
    return relations.file_edges(s).select("session_id", "source_id", "target_ref", "type", "recorded", "detail")


def relationship_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded relationships with the state of the branch that they point to."""
    s = store(spark, folder)
    return relations.with_targets(relations.tool_results(s), s.events).select("session_id", "source_id", "target_id", "type", "target_branch_state", "leads_to_leaf", "ord")


def session_lineage(spark: SparkSession, folder: str) -> DataFrame:
    x = relations.lineage(store(spark, folder).sessions)
    return x.select("session_id", "parent_id", F.array_join("child_ids", ",").alias("child_ids"))


def session_lineage_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage among the sessions below one root: a parent elsewhere doesn't exist."""
    s = store(spark, folder).sessions.filter(is_within("cwd", "/ws/frozen-manifest4") | is_within("cwd", "/ws/hidden-scanner17"))
    return relations.parents(s)


def fork_continuations(spark: SparkSession, folder: str) -> DataFrame:
    s = _hashed(spark, folder)
    return relations.continuations(s, s.sessions)


def fork_groups(spark: SparkSession, folder: str) -> DataFrame:
    s = _hashed(spark, folder)
    return relations.fork_groups(s, s.sessions)


def fork_trace_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = _hashed(spark, folder)
    return relations.fork_edges(relations.fork_groups(s, s.sessions), s.events)


def fork_way_edges(spark: SparkSession, folder: str) -> DataFrame:
    """From each way on from a fork to the others."""
    s = _hashed(spark, folder)
    return relations.fork_way_edges(relations.fork_groups(s, s.sessions), s.events)


def fork_receipts(spark: SparkSession, folder: str) -> DataFrame:
    s = _hashed(spark, folder)
    return relations.fork_receipts(relations.fork_groups(s, s.sessions), s.events)


QUERIES = {f.__name__: f for f in (tool_result_for, file_edges, relationship_targets, session_lineage, session_lineage_scoped, fork_continuations, fork_groups, fork_trace_edges, fork_way_edges, fork_receipts)}

_RESULTS = """
calls AS (
  SELECT f.session_id, f.tool_call_id, arg_max(f.entry_id, (e.append_seq, f.frag_ord)) AS target_id
  FROM f JOIN e ON e.session_id = f.session_id AND e.entry_id = f.entry_id WHERE semantic_kind = 'tool.call' AND tool_call_id IS NOT NULL GROUP BY 1, 2),
results AS (
  SELECT f.session_id, f.entry_id AS source_id, c.target_id, f.tool_call_id AS detail, e.append_seq, f.frag_ord::BIGINT AS ord
  FROM f JOIN e ON e.session_id = f.session_id AND e.entry_id = f.entry_id JOIN calls c ON c.session_id = f.session_id AND c.tool_call_id = f.tool_call_id
  WHERE semantic_kind = 'tool.result' AND f.entry_id <> c.target_id)"""
_PARENTS = """
ref AS (
  SELECT session_id, nullif(parent_session, '') AS want,
    regexp_replace(regexp_replace(regexp_replace(parent_session, '/(\\./)+', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g'), '//+', '/', 'g') AS path FROM {s}),
par AS (
  SELECT r.session_id, coalesce(i.session_id, f.session_id) AS parent_id
  FROM ref r LEFT JOIN {s} i ON i.session_id = r.want LEFT JOIN {s} f ON f.file_path = r.path WHERE coalesce(i.session_id, f.session_id) IS NOT NULL)"""
_FORKS = """
obs AS (SELECT session_id, arg_max(entry_hashes, (run_id, observed_at)) AS h FROM source_obs WHERE session_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT e.session_id, p.parent_id AS ps, e.entry_id, e.parent_id, e.append_seq, t.append_seq AS their_seq, ho.h[e.append_seq + 1] AS h1, hp.h[t.append_seq + 1] AS h2
  FROM e JOIN par p ON p.session_id = e.session_id AND p.parent_id <> e.session_id LEFT JOIN e t ON t.session_id = p.parent_id AND t.entry_id = e.entry_id
  LEFT JOIN obs ho ON ho.session_id = e.session_id LEFT JOIN obs hp ON hp.session_id = p.parent_id),
u AS (
  SELECT session_id, ps, min(append_seq) FILTER (WHERE their_seq IS NULL) AS at, min(append_seq) AS first,
    min(append_seq) FILTER (WHERE their_seq IS NOT NULL AND regexp_full_match(h1, '[0-9a-f]{8}') AND regexp_full_match(h2, '[0-9a-f]{8}') AND h1 <> h2) AS bad
  FROM c GROUP BY 1, 2),
cont AS (
  SELECT c.session_id, c.ps AS parent_session_id, c.entry_id, c.parent_id AS anchor_id
  FROM u JOIN c ON c.session_id = u.session_id AND c.ps = u.ps AND c.append_seq = u.at
  JOIN e a ON a.session_id = c.session_id AND a.entry_id = c.parent_id JOIN e b ON b.session_id = c.ps AND b.entry_id = c.parent_id
  WHERE u.at > u.first AND (u.bad IS NULL OR u.bad > u.at)),
every AS (
  SELECT parent_session_id AS at_session, anchor_id AS at_entry, session_id, entry_id FROM cont
  UNION SELECT DISTINCT parent_session_id, anchor_id, e.session_id, e.entry_id FROM cont JOIN e ON e.session_id = cont.parent_session_id AND e.parent_id = cont.anchor_id),
g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY at_session, at_entry) AS n FROM every) WHERE n > 1)"""
_P = _PARENTS.format(s="s")
SQL = {
    "tool_result_for": f"WITH {STORE}, {_RESULTS} SELECT * FROM results",
    "file_edges": f"""
WITH {STORE} SELECT f.session_id, f.entry_id AS source_id, 'file:' || unnest(f.file_paths) AS target_ref, f.file_evidence_type AS type, false AS recorded, f.tool_name AS detail
FROM f JOIN e ON e.session_id = f.session_id AND e.entry_id = f.entry_id WHERE semantic_kind = 'tool.call' AND file_evidence_type IS NOT NULL""",
    "relationship_targets": f"""
WITH RECURSIVE {STORE}, {STATES}, {_RESULTS}
SELECT r.session_id, r.source_id, r.target_id, 'tool-result-for' AS type, coalesce(v.branch_state, 'unknown') AS target_branch_state, coalesce(v.branch_state = 'selected', false) AS leads_to_leaf, r.ord
FROM results r LEFT JOIN ev v ON v.session_id = r.session_id AND v.entry_id = r.target_id""",
    "session_lineage": f"""
WITH {STORE}, {_P}, kids AS (SELECT parent_id AS session_id, string_agg(session_id, ',' ORDER BY session_id) AS child_ids FROM par GROUP BY 1)
SELECT s.session_id, p.parent_id, coalesce(k.child_ids, '') AS child_ids FROM s LEFT JOIN par p USING (session_id) LEFT JOIN kids k USING (session_id)""",
    "session_lineage_scoped": f"WITH {STORE}, z AS (SELECT * FROM s WHERE cwd = '/ws/frozen-manifest4' OR starts_with(cwd, '/ws/frozen-manifest4/') OR cwd = '/ws/hidden-scanner17' OR starts_with(cwd, '/ws/hidden-scanner17/')), {_PARENTS.format(s='z')} SELECT * FROM par",
    "fork_continuations": f"WITH {STORE}, {_P}, {_FORKS} SELECT * FROM cont",
    "fork_groups": f"WITH {STORE}, {_P}, {_FORKS} SELECT at_session, at_entry, session_id, entry_id FROM g",
    "fork_trace_edges": f"""
WITH RECURSIVE {STORE}, {STATES}, {_P}, {_FORKS},
part AS (SELECT DISTINCT at_session, at_entry, session_id FROM g UNION SELECT DISTINCT at_session, at_entry, at_session FROM g)
SELECT p.session_id, p.at_entry AS source_id, g.session_id AS to_session, g.entry_id AS to_entry, 'fork at ' || g.at_session || '/' || g.at_entry AS detail,
  coalesce(v.branch_state, 'unknown') AS target_branch_state, coalesce(v.branch_state = 'selected', false) AS leads_to_leaf
FROM part p JOIN g ON g.at_session = p.at_session AND g.at_entry = p.at_entry LEFT JOIN ev v ON v.session_id = g.session_id AND v.entry_id = g.entry_id""",
    "fork_way_edges": f"""
WITH RECURSIVE {STORE}, {STATES}, {_P}, {_FORKS},
x AS (SELECT a.session_id, a.entry_id AS source_id, b.session_id AS to_session, b.entry_id AS to_entry, 'fork at ' || a.at_session || '/' || a.at_entry AS detail,
    row_number() OVER (PARTITION BY a.at_session, a.at_entry, a.session_id, a.entry_id ORDER BY b.session_id <> b.at_session, b.session_id, b.entry_id) AS rn
  FROM g a JOIN g b ON b.at_session = a.at_session AND b.at_entry = a.at_entry AND (b.session_id, b.entry_id) <> (a.session_id, a.entry_id))
SELECT x.session_id, x.source_id, x.to_session, x.to_entry, x.detail, coalesce(v.branch_state, 'unknown') AS target_branch_state, coalesce(v.branch_state = 'selected', false) AS leads_to_leaf
FROM x LEFT JOIN ev v ON v.session_id = x.to_session AND v.entry_id = x.to_entry WHERE rn <= 20""",
    "fork_receipts": f"""
WITH RECURSIVE {STORE}, {STATES}, {_P}, {_FORKS}
SELECT g.session_id, g.at_session, g.at_entry, g.entry_id AS chosen_id FROM g JOIN ev v ON v.session_id = g.session_id AND v.entry_id = g.at_entry AND v.next_id = g.entry_id AND v.branch_state = 'selected'""",
}
