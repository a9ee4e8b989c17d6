"""What the queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.tokens import tokens_sql
from ..index import Index
from ..session import scratch
from ..store import Store, from_tables
from ..tables import Tables
from ..functions.text import OMITTED


def store(spark: SparkSession, folder: str) -> Store:
    """The store of a folder's tables, computed anew."""
    return from_tables(Tables(spark, folder))


_INDEXES: dict[tuple[str, ...], Index] = {}


def indexed(spark: SparkSession, folder: str) -> Store:
    """The store of a folder's tables out of a saved index, which the first search of a session builds, and builds
    again where the tables' files have changed."""
    jvm = spark._jvm
    key = [spark.sparkContext.applicationId, folder]
    for table in ("sessions", "entries", "fragments"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}.parquet")
        s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
        key += [str(s.getLength()), str(s.getFileCount()), str(at)]
    if tuple(key) not in _INDEXES:
        index = Index(spark, scratch(spark, "index"))
        index.apply(store(spark, folder))
        _INDEXES[tuple(key)] = index
    return _INDEXES[tuple(key)].store()


_HEAD = -(-(10_000 - len(OMITTED)) // 2)
_TAIL = (10_000 - len(OMITTED)) // 2
_MARK = "'" + OMITTED.replace("\n", "' || chr(10) || '") + "'"
BOUNDED = f"CASE WHEN length(frag_text) <= 10000 THEN frag_text ELSE substr(frag_text, 1, {_HEAD}) || {_MARK} || right(frag_text, {_TAIL}) END"

#: SQL of the store's tables: s (sessions), e (entries), f (fragments).
STORE = f"""
s AS (
  SELECT session_id, created_at, cwd, parent_session, session_name, file_path FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ingested_at DESC, created_at DESC) AS rn FROM sessions WHERE session_id IS NOT NULL) WHERE rn = 1),
e AS (
  SELECT session_id, entry_id, parent_id, entry_ts, entry_type, entry_role, context_role,
         row_number() OVER (PARTITION BY session_id ORDER BY append_seq, entry_id) - 1 AS append_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_id ORDER BY ingested_at DESC) AS rn FROM entries) WHERE rn = 1),
f AS (
  SELECT DISTINCT session_id, entry_id, fragment_id, semantic_kind, frag_text, tool_name, tool_call_id, is_error, custom_type, file_paths, file_evidence_type,
         coalesce(try_cast(nullif(regexp_extract(fragment_id, '::(\\d+)$', 1), '') AS INTEGER), 0) AS frag_ord
  FROM fragments WHERE frag_text IS NOT NULL)"""

#: SQL of the tokens of all fragments: k.
TOKENS = f"k AS (SELECT *, {tokens_sql(BOUNDED)} AS tokens FROM f)"

#: SQL of the states of all entries: ev. Needs WITH RECURSIVE.
STATES = """
leaf AS (SELECT session_id, arg_max(entry_id, append_seq) AS entry_id FROM e GROUP BY 1),
up AS (
  SELECT e.session_id, e.entry_id, e.parent_id, 0 AS back, [e.entry_id] AS met FROM e JOIN leaf l ON l.session_id = e.session_id AND l.entry_id = e.entry_id
  UNION ALL
  SELECT p.session_id, p.entry_id, p.parent_id, u.back + 1, list_append(u.met, p.entry_id) FROM up u JOIN e p ON p.session_id = u.session_id AND p.entry_id = u.parent_id
  WHERE NOT list_contains(u.met, p.entry_id)),
kids AS (SELECT session_id, parent_id AS entry_id, count(*) AS n_children, arg_min(entry_id, append_seq) AS child FROM e WHERE parent_id IS NOT NULL GROUP BY 1, 2),
until AS (SELECT u.session_id, max(e.append_seq) AS until FROM up u JOIN e ON e.session_id = u.session_id AND e.entry_id = u.entry_id WHERE e.entry_type = 'compaction' GROUP BY 1),
ev AS (
  SELECT e.*, u.back, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN u.back IS NOT NULL THEN 'selected' WHEN e.parent_id IS NOT NULL AND p.entry_id IS NULL THEN 'unknown' ELSE 'alternate' END AS branch_state,
    CASE WHEN u.back IS NULL THEN 'not-selected' WHEN e.context_role IN ('metadata', 'control') THEN 'not-applicable' WHEN e.context_role = 'summary' THEN 'direct'
         WHEN e.append_seq < t.until THEN 'summarized' ELSE 'direct' END AS selection_state,
    CASE WHEN u.back IS NOT NULL THEN n.entry_id WHEN c.n_children = 1 THEN c.child END AS next_id
  FROM e LEFT JOIN up u ON u.session_id = e.session_id AND u.entry_id = e.entry_id
  LEFT JOIN up n ON n.session_id = u.session_id AND n.back = u.back - 1
  LEFT JOIN kids c ON c.session_id = e.session_id AND c.entry_id = e.entry_id
  LEFT JOIN e p ON p.session_id = e.session_id AND p.entry_id = e.parent_id
  LEFT JOIN until t ON t.session_id = e.session_id)"""
