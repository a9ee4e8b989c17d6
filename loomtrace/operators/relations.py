"""Relationships of entries: tool results, recorded links, files, lineage of sessions, and forks across sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.paths import normalized
from ..store import Store
from .incremental import is_durable

#: Groups of relationships in the order in which they are listed.
TOOL_RESULT_FOR, COMPACTS, BRANCH_SUMMARY_FROM, LABELS = "tool-result-for", "compacts", "branch-summary-from", "labels"
FILE_READ, FILE_CHANGED, SESSION_PARENT, SESSION_FORK = "file-read", "file-changed", "session-parent", "session-fork"
#: Columns of a relationship; (grp, append_seq, ord) is its place in the session's list.
EDGE = ["session_id", "source_id", "target_id", "target_ref", "type", "recorded", "detail", "grp", "append_seq", "ord"]


def tool_results(store: Store) -> DataFrame:
    """Each result fragment linked to the entry that called: of several calls with an id the last counts, and a
    result within the calling entry is no link. Fragments without call id are left out."""
    f = store.fragments.filter("tool_call_id IS NOT NULL").join(store.entries.select("session_id", "entry_id", "append_seq"), ["session_id", "entry_id"])
    calls = f.filter("semantic_kind = 'tool.call'").groupBy("session_id", "tool_call_id").agg(F.max_by("entry_id", F.struct("append_seq", "frag_ord")).alias("target_id"))
    results = f.filter("semantic_kind = 'tool.result'").join(calls, ["session_id", "tool_call_id"]).filter("entry_id <> target_id")
    return results.select(
        "session_id", F.col("entry_id").alias("source_id"), "target_id", F.lit(None).cast("string").alias("target_ref"), F.lit(TOOL_RESULT_FOR).alias("type"),
        F.lit(True).alias("recorded"), F.col("tool_call_id").alias("detail"), F.lit(0).alias("grp"), "append_seq", F.col("frag_ord").cast("long").alias("ord"),
    )


def file_edges(store: Store) -> DataFrame:
    """Each file that a call read or changed, as file:path; inferred, not recorded."""
    f = store.fragments.filter("semantic_kind = 'tool.call' AND file_evidence_type IS NOT NULL AND file_paths IS NOT NULL")
    f = f.select("session_id", "entry_id", "tool_name", "file_evidence_type", "frag_ord", F.posexplode("file_paths").alias("pos", "path"))
    f = f.join(store.entries.select("session_id", "entry_id", "append_seq"), ["session_id", "entry_id"])
    return f.select(
        "session_id", F.col("entry_id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.concat(F.lit("file:"), "path").alias("target_ref"),
        F.when(F.col("file_evidence_type") == FILE_READ, FILE_READ).otherwise(FILE_CHANGED).alias("type"), F.lit(False).alias("recorded"),
        F.col("tool_name").alias("detail"), F.lit(2).alias("grp"), "append_seq", (F.col("frag_ord").cast("long") * 1_000_000 + F.col("pos")).alias("ord"),
    )


def relationships(store: Store) -> DataFrame:
    """All relationships, EDGE's columns: results to calls, what entries record, files."""
    out = tool_results(store)
    if store.links is not None:
        out = out.unionByName(store.links.select(*EDGE))
    return out.unionByName(file_edges(store))


def with_targets(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges with target_branch_state (unknown if the target isn't there) and leads_to_leaf."""
    t = events.select("session_id", F.col("entry_id").alias("target_id"), F.col("branch_state").alias("__b"))
    e = edges.join(t, ["session_id", "target_id"], "left")
    return e.select(*edges.columns, F.coalesce("__b", F.lit("unknown")).alias("target_branch_state"), F.coalesce(F.col("__b") == "selected", F.lit(False)).alias("leads_to_leaf"))


def parents(sessions: DataFrame) -> DataFrame:
    """session_id, parent_id of each session whose parent is among the sessions: by id, else by normalised file path
    (of several with the path the least id)."""
    s = sessions.select("session_id", F.when(F.col("parent_session") != "", F.col("parent_session")).alias("want"), "file_path")
    child = s.filter("want IS NOT NULL").withColumn("path", normalized(F.col("want")))
    ids = s.select(F.col("session_id").alias("want"), F.lit(True).alias("is_id"))
    files = s.filter("file_path IS NOT NULL").groupBy(normalized(F.col("file_path")).alias("path")).agg(F.min("session_id").alias("by_path"))
    child = child.join(ids, "want", "left").join(files, "path", "left")
    return child.select("session_id", F.when(F.col("is_id"), F.col("want")).otherwise(F.col("by_path")).alias("parent_id")).filter("parent_id IS NOT NULL")


def lineage(sessions: DataFrame) -> DataFrame:
    """session_id, parent_id, child_ids (sorted) of every session."""
    p = parents(sessions)
    kids = p.groupBy(F.col("parent_id").alias("session_id")).agg(F.array_sort(F.collect_set("session_id")).alias("child_ids"))
    out = sessions.select("session_id").join(p, "session_id", "left").join(kids, "session_id", "left")
    return out.withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def continuations(store: Store, sessions: DataFrame) -> DataFrame:
    """session_id, entry_id, parent_session_id, anchor_id: the first entry of a forked session that its parent doesn't
    have. There must be shared entries before it, none of them with another durable hash, and its own parent must be
    in both sessions."""
    p = parents(sessions).withColumnRenamed("parent_id", "parent_session_id").filter("session_id <> parent_session_id")
    e = store.entries.select("session_id", "entry_id", "parent_id", "append_seq")
    c = salted_join(e, p, ["session_id"], ["entry_id"])
    theirs = e.select(F.col("session_id").alias("parent_session_id"), "entry_id", F.col("append_seq").alias("their_seq"))
    c = c.join(theirs, ["parent_session_id", "entry_id"], "left")
    different = F.lit(False)
    if store.hashes is not None:
        h = store.hashes.select("session_id", "append_seq", "hash")
        c = c.join(h, ["session_id", "append_seq"], "left")
        c = c.join(h.select(F.col("session_id").alias("parent_session_id"), F.col("append_seq").alias("their_seq"), F.col("hash").alias("their_hash")), ["parent_session_id", "their_seq"], "left")
        different = is_durable(F.col("hash")) & is_durable(F.col("their_hash")) & (F.col("hash") != F.col("their_hash"))
    shared = F.col("their_seq").isNotNull()
    own = c.groupBy("session_id", "parent_session_id").agg(
        F.min_by(F.struct("entry_id", "parent_id", "append_seq"), F.when(~shared, F.col("append_seq"))).alias("u"),
        F.min(F.when(~shared, F.col("append_seq"))).alias("at"),
        F.min("append_seq").alias("first"),
        F.min(F.when(shared & F.coalesce(different, F.lit(False)), F.col("append_seq"))).alias("bad"),
    )
    own = own.filter("at > first AND (bad IS NULL OR bad > at) AND u.parent_id IS NOT NULL")
    own = own.select("session_id", "parent_session_id", F.col("u.entry_id").alias("entry_id"), F.col("u.parent_id").alias("anchor_id"))
    ids = e.select("session_id", F.col("entry_id").alias("anchor_id"))
    own = own.join(ids, ["session_id", "anchor_id"], "left_semi")
    return own.join(ids.withColumnRenamed("session_id", "parent_session_id"), ["parent_session_id", "anchor_id"], "left_semi")


def fork_groups(store: Store, sessions: DataFrame) -> DataFrame:
    """at_session, at_entry, session_id, entry_id: the ways on from each anchor, those within the parent session and
    the first of each forked session; anchors with one way on are no forks."""
    c = continuations(store, sessions).select(F.col("parent_session_id").alias("at_session"), F.col("anchor_id").alias("at_entry"), "session_id", "entry_id")
    own = c.select("at_session", "at_entry").distinct()
    kids = store.entries.select(F.col("session_id").alias("at_session"), F.col("parent_id").alias("at_entry"), F.col("session_id").alias("session_id"), "entry_id")
    every = c.unionByName(kids.join(own, ["at_session", "at_entry"], "left_semi")).distinct()
    many = every.groupBy("at_session", "at_entry").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return every.join(many, ["at_session", "at_entry"], "left_semi")


def fork_edges(groups: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, source_id, to_session, to_entry, detail, target_branch_state, leads_to_leaf: from each anchor, in
    every session that takes part, to all ways on. (Ways on among themselves are the group's rows.)"""
    at = groups.select("at_session", "at_entry", F.col("session_id").alias("to_session"), F.col("entry_id").alias("to_entry"))
    takes_part = groups.select("at_session", "at_entry", "session_id").distinct().unionByName(groups.select("at_session", "at_entry", F.col("at_session").alias("session_id")).distinct()).distinct()
    e = takes_part.join(at, ["at_session", "at_entry"])
    state = events.select(F.col("session_id").alias("to_session"), F.col("entry_id").alias("to_entry"), "branch_state")
    e = e.join(state, ["to_session", "to_entry"], "left")
    return e.select(
        "session_id", F.col("at_entry").alias("source_id"), "to_session", "to_entry", F.concat(F.lit("fork at "), "at_session", F.lit("/"), "at_entry").alias("detail"),
        F.coalesce("branch_state", F.lit("unknown")).alias("target_branch_state"), F.coalesce(F.col("branch_state") == "selected", F.lit(False)).alias("leads_to_leaf"),
    )


def first_of_each(df: DataFrame, key: list[str], order: list, n: int, spread: list[str], salts: int = 16) -> DataFrame:
    """The first n rows of each key with their places (from 0): first of the parts that spread makes of it, then of what
    these leave. So no task sorts all rows of a key."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    some = part.withColumn("__i", F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(*order))).filter(F.col("__i") <= n)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).filter(F.col("place") < n).drop("__salt", "__i")


def fork_way_edges(groups: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, source_id, to_session, to_entry, detail, target_branch_state, leads_to_leaf: from each way on to up
    to limit others of its group, the anchor's own session first, then by session and entry."""
    key = ["at_session", "at_entry"]
    g = groups.select(*key, "session_id", "entry_id")
    order = [F.col("session_id") != F.col("at_session"), F.col("session_id"), F.col("entry_id")]
    first = first_of_each(g, key, order, limit + 1, ["session_id", "entry_id"]).select(*key, F.col("session_id").alias("to_session"), F.col("entry_id").alias("to_entry"), "place")
    mine = g.join(first.select(*key, F.col("to_session").alias("session_id"), F.col("to_entry").alias("entry_id"), F.col("place").alias("own")), [*key, "session_id", "entry_id"], "left")
    e = salted_join(mine, first, key, ["session_id", "entry_id"])
    e = e.filter((F.col("to_session") != F.col("session_id")) | (F.col("to_entry") != F.col("entry_id"))).filter(F.col("place") < limit + (F.coalesce("own", F.lit(limit + 1)) < limit).cast("int"))
    state = events.select(F.col("session_id").alias("to_session"), F.col("entry_id").alias("to_entry"), "branch_state")
    e = e.join(state, ["to_session", "to_entry"], "left")
    return e.select(
        "session_id", F.col("entry_id").alias("source_id"), "to_session", "to_entry", F.concat(F.lit("fork at "), "at_session", F.lit("/"), "at_entry").alias("detail"),
        F.coalesce("branch_state", F.lit("unknown")).alias("target_branch_state"), F.coalesce(F.col("branch_state") == "selected", F.lit(False)).alias("leads_to_leaf"),
    )


def fork_receipts(groups: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, at_session, at_entry, chosen_id: forks across sessions that a session's selected branch passes: the
    branch steps from the anchor to one of the group's ways on that lies in this session."""
    step = events.filter("branch_state = 'selected' AND next_id IS NOT NULL").select("session_id", F.col("entry_id").alias("at_entry"), F.col("next_id").alias("entry_id"))
    return groups.join(step, ["session_id", "at_entry", "entry_id"]).select("session_id", "at_session", "at_entry", F.col("entry_id").alias("chosen_id"))
