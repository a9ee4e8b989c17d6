"""Queries of session trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from ..store import session_names
from ..service import History
from .base import STATES, STORE, indexed, store


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its place in the log and on the branch, and its states."""
    e = store(spark, folder).events
    return e.select("session_id", "entry_id", "append_seq", "branch_state", "selection_state", "back", "n_children", "next_id")


def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = store(spark, folder).events
    return e.groupBy("entry_type", "context_role", "branch_state", "selection_state").agg(F.count("*").alias("n"))


def branch_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five entries above every entry."""
    e = store(spark, folder).entries
    return tree.ancestors(e, None, 5)


def branch_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five entries that continue every entry's branch."""
    e = store(spark, folder).events
    return tree.descendants(e, None, 5)


def append_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return tree.append_neighbors(store(spark, folder).entries, 2, 3)


def tree_children(spark: SparkSession, folder: str) -> DataFrame:
    return tree.children(store(spark, folder).entries)


def branch_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """Up to fifty siblings of every entry, and how many it has."""
    return tree.siblings(store(spark, folder).entries)


def in_session_forks(spark: SparkSession, folder: str) -> DataFrame:
    return tree.forks(store(spark, folder).events)


def session_name(spark: SparkSession, folder: str) -> DataFrame:
    return session_names(store(spark, folder))


def trace_event(spark: SparkSession, folder: str) -> DataFrame:
    """What the service tells of the entry with the most children: parent, children and siblings, each as it is listed."""
    s = indexed(spark, folder)
    e = s.events.orderBy(F.col("n_children").desc(), "session_id", "entry_id").first()
    t = History(s).trace(e.session_id, e.entry_id)
    rows = [(i, x["type"], *x["from"], *x["to"], x["recorded"], x["target_branch_state"], x["leads_to_leaf"]) for part in ([t["parent"]] if t["parent"] else [], t["children"], t["siblings"]) for i, x in enumerate(part)]
    return spark.createDataFrame(rows, "place long, type string, from_session string, from_entry string, to_session string, to_entry string, recorded boolean, target_branch_state string, leads_to_leaf boolean")


def read_event(spark: SparkSession, folder: str) -> DataFrame:
    """What the service reads of the entry with the most characters: its fragments within the reading budget."""
    s = indexed(spark, folder)
    n = s.fragments.groupBy("session_id", "entry_id").agg(F.sum(F.char_length("frag_text")).alias("n"))
    e = n.join(s.entries, ["session_id", "entry_id"], "left_semi").orderBy(F.col("n").desc(), "session_id", "entry_id").first()
    r = History(s).read(e.session_id, e.entry_id)
    rows = [(e.session_id, e.entry_id, f["fragment_id"], f["preview"]["text"], f["preview"]["total"], f["preview"]["truncated"], r["coverage"]["total"], r["coverage"]["returned"]) for f in r["fragments"]]
    return spark.createDataFrame(rows, "session_id string, entry_id string, fragment_id string, text string, total long, truncated boolean, n_fragments long, n_returned long")


QUERIES = {f.__name__: f for f in (events, state_counts, branch_ancestors, branch_descendants, append_neighbors, tree_children, branch_siblings, in_session_forks, session_name, trace_event, read_event)}
_STEPS = """
step AS (
  SELECT session_id, entry_id AS target_id, entry_id, 0::BIGINT AS distance, [entry_id] AS met FROM {source}
  UNION ALL
  SELECT t.session_id, t.target_id, n.entry_id, t.distance + 1, list_append(t.met, n.entry_id)
  FROM step t JOIN {source} x ON x.session_id = t.session_id AND x.entry_id = t.entry_id JOIN {source} n ON n.session_id = x.session_id AND n.entry_id = x.{link}
  WHERE t.distance < 5 AND NOT list_contains(t.met, n.entry_id))
SELECT session_id, target_id, entry_id, distance FROM step WHERE distance > 0"""
SQL = {
    "events": f"WITH RECURSIVE {STORE}, {STATES} SELECT session_id, entry_id, append_seq, branch_state, selection_state, back, n_children, next_id FROM ev",
    "state_counts": f"WITH RECURSIVE {STORE}, {STATES} SELECT entry_type, context_role, branch_state, selection_state, count(*) AS n FROM ev GROUP BY ALL",
    "branch_ancestors": f"WITH RECURSIVE {STORE}, " + _STEPS.format(source="e", link="parent_id"),
    "branch_descendants": f"WITH RECURSIVE {STORE}, {STATES}, " + _STEPS.format(source="ev", link="next_id"),
    "append_neighbors": f"WITH {STORE} SELECT a.session_id, a.entry_id, b.entry_id AS neighbor_id, b.append_seq - a.append_seq AS distance FROM e a JOIN e b ON b.session_id = a.session_id AND b.append_seq BETWEEN a.append_seq - 2 AND a.append_seq + 3 AND b.append_seq <> a.append_seq",
    "tree_children": f"WITH {STORE} SELECT session_id, parent_id, entry_id, row_number() OVER (PARTITION BY session_id, parent_id ORDER BY append_seq) - 1 AS place FROM e WHERE parent_id IS NOT NULL",
    "branch_siblings": f"""
WITH {STORE}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, parent_id ORDER BY append_seq) - 1 AS place, count(*) OVER (PARTITION BY session_id, parent_id) AS n FROM e WHERE parent_id IS NOT NULL),
x AS (SELECT a.session_id, a.entry_id, b.entry_id AS sibling_id, a.n - 1 AS n_siblings, row_number() OVER (PARTITION BY a.session_id, a.entry_id ORDER BY b.place) AS rn
  FROM c a JOIN c b ON b.session_id = a.session_id AND b.parent_id = a.parent_id AND b.entry_id <> a.entry_id)
SELECT session_id, entry_id, sibling_id, n_siblings FROM x WHERE rn <= 50""",
    "in_session_forks": f"WITH RECURSIVE {STORE}, {STATES} SELECT a.session_id, a.entry_id AS at_entry, b.entry_id AS candidate_id, coalesce(a.branch_state = 'selected' AND b.entry_id = a.next_id, false) AS chosen FROM ev a JOIN ev b ON b.session_id = a.session_id AND b.parent_id = a.entry_id WHERE a.n_children > 1",
    "session_name": rf"WITH {STORE} SELECT session_id, arg_min(name, (append_seq, frag_ord)) AS session_name FROM (SELECT f.session_id, append_seq, frag_ord, trim(regexp_replace(frag_text, '\s+', ' ', 'g')) AS name FROM f JOIN e ON e.session_id = f.session_id AND e.entry_id = f.entry_id WHERE semantic_kind = 'session.name') WHERE name <> '' GROUP BY 1",
    "trace_event": f"""
WITH RECURSIVE {STORE}, {STATES}, t AS (SELECT * FROM ev ORDER BY n_children DESC, session_id, entry_id LIMIT 1),
x AS (
  SELECT 0 AS place, 'parent' AS type, t.parent_id AS to_entry, true AS recorded FROM t WHERE t.parent_id IS NOT NULL
  UNION ALL SELECT row_number() OVER (ORDER BY e.append_seq) - 1, 'child', e.entry_id, true FROM t JOIN ev e ON e.session_id = t.session_id AND e.parent_id = t.entry_id QUALIFY row_number() OVER (ORDER BY e.append_seq) <= 50
  UNION ALL SELECT row_number() OVER (ORDER BY e.append_seq) - 1, 'branch-sibling', e.entry_id, false FROM t JOIN ev e ON e.session_id = t.session_id AND e.parent_id = t.parent_id AND e.entry_id <> t.entry_id QUALIFY row_number() OVER (ORDER BY e.append_seq) <= 50)
SELECT x.place, x.type, t.session_id AS from_session, t.entry_id AS from_entry, t.session_id AS to_session, x.to_entry, x.recorded,
  coalesce(v.branch_state, 'unknown') AS target_branch_state, coalesce(v.branch_state = 'selected', false) AS leads_to_leaf
FROM x, t LEFT JOIN ev v ON v.session_id = t.session_id AND v.entry_id = x.to_entry""",
    "read_event": f"""
WITH {STORE}, n AS (SELECT f.session_id, f.entry_id, sum(length(frag_text)) AS n, count(*) AS total FROM f JOIN e ON e.session_id = f.session_id AND e.entry_id = f.entry_id GROUP BY ALL),
t AS (SELECT *, least(total, 20) AS shown, least(2000, greatest(1, 6000 // least(total, 20))) AS cap FROM n ORDER BY n DESC, session_id, entry_id LIMIT 1)
SELECT t.session_id, t.entry_id, fragment_id, CASE WHEN length(frag_text) > cap THEN substr(frag_text, 1, ceil(cap / 2)::INT) || '…' || right(frag_text, floor(cap / 2)::INT) ELSE frag_text END AS text,
  length(frag_text) AS total, length(frag_text) > cap AS truncated, t.total AS n_fragments, t.shown AS n_returned
FROM t JOIN f ON f.session_id = t.session_id AND f.entry_id = t.entry_id QUALIFY row_number() OVER (ORDER BY frag_ord, semantic_kind) <= 20""",
}
