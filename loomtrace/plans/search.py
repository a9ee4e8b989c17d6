"""Queries of full-text search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import frequency_sql, parse_query
from ..functions.joins import salted_join
from ..index import Index
from ..operators.search import LIMIT, Execution, Request, cutoffs, lists, matches, search, statistics
from ..session import scratch
from ..store import Store, cached
from .base import STATES, STORE, TOKENS, indexed, store

#: name -> (request, root, limit)
REQUESTS: dict[str, tuple[Request, str, int | None]] = {
    "search_terms": (Request("lockfile parser"), "/", LIMIT),
    "search_all_hits": (Request("stale cursor"), "/", None),
    "search_phrase": (Request('"visible deadline"'), "/", None),
    "search_phrase_and_term": (Request('"explain the" watermark'), "/", None),
    "search_cjk": (Request("要約 解析"), "/", None),
    "search_cjk_phrase": (Request('"解析"'), "/", None),
    "search_accents": (Request("resume"), "/", None),
    "search_accented_query": (Request("résumé"), "/", None),
    "search_separators": (Request("src/lockfile"), "/", None),
    "search_no_token": (Request("!!!"), "/", None),
    "search_ignored_piece": (Request("!!! watermark"), "/", LIMIT),
    "search_repeated_term": (Request("cursor cursor"), "/", LIMIT),
    "filter_kinds": (Request("snapshot", kinds=("user.text", "assistant.text")), "/", None),
    "filter_tool_names": (Request("snapshot", tool_names=("event_search", "grep")), "/", None),
    "filter_role_time": (Request("manifest", roles=("user",), time_from="2024-05-01", time_to="2024-06-30"), "/", None),
    "filter_entry_types": (Request("manifest", entry_types=("compaction", "bash")), "/", None),
    "filter_error_only": (Request("replay", error_only=True), "/", None),
    "filter_branch": (Request("registry", branch_states=("alternate", "unknown")), "/", None),
    "filter_selection": (Request("registry", selection_states=("summarized",)), "/", None),
    "filter_scope": (Request("ledger", cwd="/ws/frozen-manifest4"), "/ws", None),
    "filter_scope_border": (Request("ledger", cwd="/ws/frozen-manifest"), "/ws", None),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    r, root, limit = REQUESTS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = search(indexed(spark, folder), r, root, limit=limit)
        return hits.withColumn("score", F.round("score", 6))

    return run


def search_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A search without a saved index: over the texts as they are."""
    r, root, limit = REQUESTS["search_terms"]
    return search(store(spark, folder), r, root, limit=limit).withColumn("score", F.round("score", 6))


def _quote(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql(name: str) -> str:
    r, root, limit = REQUESTS[name]
    q = parse_query(r.query)
    if not q.sequences:
        return "SELECT session_id, session_name, cwd, '' AS entry_id, '' AS entry_type, '' AS fragment_id, '' AS semantic_kind, '' AS entry_ts, '' AS branch_state, '' AS selection_state, '' AS snippet, 0::BIGINT AS n_fragments, 0.0::DOUBLE AS score FROM sessions WHERE false"
    own = list(dict.fromkeys(q.sequences))
    tf = ", ".join(f"{frequency_sql('tokens', s)} AS tf_{i}" for i, s in enumerate(own))
    df = ", ".join(f"sum((tf_{i} > 0)::INT) AS df_{i}" for i in range(len(own)))
    terms = " + ".join(
        f"(CASE WHEN ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) > 0 THEN ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) ELSE 1e-6 END) * (tf_{i} * 2.2) / (tf_{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in (own.index(s) for s in q.sequences)
    )
    where = [f"tf_{i} > 0" for i in range(len(own))]
    if r.kinds:
        where.append(f"semantic_kind IN ({_quote(r.kinds)})")
    where.append(f"tool_name IN ({_quote(r.tool_names)})" if r.tool_names else "coalesce(tool_name, '') NOT IN ('event_search', 'event_read', 'event_trace')")
    if r.error_only:
        where.append("is_error")
    for column, values in (("entry_type", r.entry_types), ("entry_role", r.roles), ("branch_state", r.branch_states), ("selection_state", r.selection_states)):
        if values:
            where.append(f"{column} IN ({_quote(values)})")
    if r.time_from:
        where.append(f"entry_ts >= '{r.time_from}'")
    if r.time_to:
        where.append(f"entry_ts <= '{r.time_to}'")
    for scope in filter(None, (root, r.cwd)):
        where.append("cwd LIKE '/%'" if scope == "/" else f"(cwd = '{scope}' OR starts_with(cwd, '{scope}/'))")
    low = [t.lower() for t in [*q.terms, *q.phrases]]
    places = ", ".join(f"nullif(instr(lower(t), '{x}'), 0)" for x in low)
    first = f"coalesce(least({places}), 0)" if len(low) > 1 else f"coalesce({places}, 0)"
    return f"""
WITH RECURSIVE {STORE}, {TOKENS}, {STATES},
c AS (SELECT * EXCLUDE (tokens), len(tokens) AS size, {tf} FROM k),
stat AS (SELECT count(*) AS n, avg(size) AS mean, {df} FROM c),
hit AS (
  SELECT c.*, ev.entry_type, ev.entry_ts, ev.branch_state, ev.selection_state, ev.append_seq, s.session_name, s.cwd, -({terms}) AS score
  FROM c, stat JOIN ev ON ev.session_id = c.session_id AND ev.entry_id = c.entry_id JOIN s ON s.session_id = c.session_id
  WHERE {' AND '.join(where)}),
best AS (
  SELECT *, count(*) OVER (PARTITION BY session_id, entry_id) AS n_fragments,
         row_number() OVER (PARTITION BY session_id, entry_id ORDER BY score, semantic_kind, frag_ord, fragment_id) AS rn FROM hit),
top AS (SELECT *, trim(regexp_replace(frag_text, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'), ' ') AS t FROM best WHERE rn = 1
  ORDER BY score, session_id, append_seq, semantic_kind, frag_ord {f'LIMIT {limit}' if limit else ''}),
m AS (SELECT *, {first} AS m FROM top)
SELECT session_id, session_name, cwd, entry_id, entry_type, fragment_id, semantic_kind, entry_ts, branch_state, selection_state, n_fragments, round(score, 6) AS score,
  CASE WHEN length(t) <= 240 THEN t WHEN m = 0 THEN substr(t, 1, 240) ELSE substr(t, greatest(m - 81, 0) + 1, least(length(t), m + 159) - greatest(m - 81, 0)) END AS snippet
FROM m"""


_SEQUENCES = [("lockfile",), ("explain", "the"), ("要",)]


def bm25_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return statistics(store(spark, folder).fragments, _SEQUENCES).withColumn("mean", F.round("mean", 6))


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbers out of a saved index."""
    s = indexed(spark, folder)
    df = lists(s, _SEQUENCES).agg(*[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(_SEQUENCES))])
    n, total = s.sizes
    return df.select(F.lit(n).cast("long").alias("n"), F.round(F.lit(total / n if n else None).cast("double"), 6).alias("mean"), "*")


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """In how many fragments each token occurs, and how often."""
    p = indexed(spark, folder).postings
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("cf"))


def matching_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Every fragment that holds two terms, with their frequencies, its length and its score."""
    q = parse_query("manifest snapshot")
    m = matches(indexed(spark, folder), q, Request("manifest snapshot"))
    return m.select("session_id", "fragment_id", F.col("tf_0").cast("long").alias("tf_0"), F.col("tf_1").cast("long").alias("tf_1"), F.round("score", 6).alias("score"))


_AT = "2024-06-15T00:00:00.000Z"


def _largest(s: Store) -> str:
    return s.entries.groupBy("session_id").count().orderBy(F.col("count").desc(), "session_id").first()["session_id"]


def search_session(spark: SparkSession, folder: str) -> DataFrame:
    """A search within the largest session."""
    s = indexed(spark, folder)
    return search(s, Request("cursor", session_id=_largest(s)), limit=None).withColumn("score", F.round("score", 6))


def search_current_session(spark: SparkSession, folder: str) -> DataFrame:
    """The same, asked by that session from its middle entry: only what comes before that."""
    s = indexed(spark, folder)
    sid = _largest(s)
    own = s.entries.filter(F.col("session_id") == sid)
    middle = own.filter(F.col("append_seq") == own.count() // 2).first()
    return search(s, Request("cursor", session_id=sid), execution=Execution(sid, middle["entry_id"] if middle else None, _AT), limit=None).withColumn("score", F.round("score", 6))


def search_other_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A search by the largest session through all others."""
    s = indexed(spark, folder)
    return search(s, Request("stale cursor"), execution=Execution(_largest(s), None, _AT), limit=None).withColumn("score", F.round("score", 6))


def _grown(spark: SparkSession, folder: str, how: str) -> DataFrame:
    """Hits of one request in an index that has been changed."""
    whole = cached(store(spark, folder))
    index = Index(spark, scratch(spark, how))
    r, root, limit = REQUESTS["search_all_hits"]
    if how == "store_remove":
        index.apply(whole)
        index.apply(removed=whole.sessions.filter("parent_session IS NOT NULL").select("session_id"))
    else:
        n = whole.entries.groupBy("session_id").agg(F.floor(F.count("*") / 2).cast("long").alias("n_before"))
        early = salted_join(whole.entries, n, ["session_id"], ["entry_id"]).filter("append_seq < n_before").drop("n_before")
        part = Store(whole.sessions, early, whole.fragments.join(early.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi"))
        index.apply(part)
        index.apply(whole, n if how == "store_append" else None)
    return search(index.store(), r, root, limit=limit).withColumn("score", F.round("score", 6))


def store_append(spark: SparkSession, folder: str) -> DataFrame:
    """A search after the later half of every session's entries was appended to an index."""
    return _grown(spark, folder, "store_append")


def store_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """A search after every session of an index was replaced."""
    return _grown(spark, folder, "store_rebuild")


def store_remove(spark: SparkSession, folder: str) -> DataFrame:
    """A search after the sessions with a parent were removed from an index."""
    return _grown(spark, folder, "store_remove")


def index_build(spark: SparkSession, folder: str) -> DataFrame:
    """A new index of the tables: what it holds by kind."""
    index = Index(spark, scratch(spark, "index_build"))
    index.apply(store(spark, folder))
    s = index.store()
    return s.fragments.groupBy("semantic_kind").agg(F.count("*").alias("n"))


def cutoff_current(spark: SparkSession, folder: str) -> DataFrame:
    """Every session's cutoff if it asked at a time."""
    return cutoffs(store(spark, folder).entries, "2024-07-01T00:00:00.000Z")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in REQUESTS} | {f.__name__: f for f in (search_scan, search_session, search_current_session, search_other_sessions, store_append, store_rebuild, store_remove, index_build, cutoff_current, bm25_corpus_stats, index_stats, document_frequency, matching_fragments)}
SQL = {n: _sql(n) for n in REQUESTS} | {
    "bm25_corpus_stats": f"WITH {STORE}, {TOKENS} SELECT count(*) AS n, round(avg(len(tokens)), 6) AS mean, " + ", ".join(f"sum(({frequency_sql('tokens', s)} > 0)::INT)::BIGINT AS df_{i}" for i, s in enumerate(_SEQUENCES)) + " FROM k",
    "document_frequency": f"WITH {STORE}, {TOKENS}, x AS (SELECT row_number() OVER () AS i, tokens FROM k), u AS (SELECT i, unnest(tokens) AS token FROM x), g AS (SELECT i, token, count(*) AS tf FROM u GROUP BY ALL) SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM g GROUP BY token",
    "matching_fragments": f"""
WITH {STORE}, {TOKENS}, c AS (SELECT *, len(tokens) AS size, {frequency_sql('tokens', ('manifest',))} AS tf_0, {frequency_sql('tokens', ('snapshot',))} AS tf_1 FROM k),
stat AS (SELECT count(*) AS n, avg(size) AS mean, sum((tf_0 > 0)::INT) AS d0, sum((tf_1 > 0)::INT) AS d1 FROM c)
SELECT session_id, fragment_id, tf_0::BIGINT AS tf_0, tf_1::BIGINT AS tf_1,
  round(-(ln((n - d0 + 0.5) / (d0 + 0.5)) * (tf_0 * 2.2) / (tf_0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln((n - d1 + 0.5) / (d1 + 0.5)) * (tf_1 * 2.2) / (tf_1 + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
FROM c, stat WHERE tf_0 > 0 AND tf_1 > 0 AND coalesce(tool_name, '') NOT IN ('event_search', 'event_read', 'event_trace')""",
}
SQL["store_append"] = SQL["store_rebuild"] = SQL["search_all_hits"]
SQL["store_remove"] = SQL["search_all_hits"].replace("FROM fragments WHERE frag_text IS NOT NULL", "FROM fragments WHERE frag_text IS NOT NULL AND session_id NOT IN (SELECT session_id FROM s WHERE parent_session IS NOT NULL)")
SQL["index_build"] = f"WITH {STORE} SELECT semantic_kind, count(*) AS n FROM f GROUP BY 1"
SQL["cutoff_current"] = f"WITH {STORE} SELECT session_id, coalesce(min(append_seq) FILTER (entry_ts >= '2024-07-01T00:00:00.000Z'), count(*)) AS cutoff FROM e GROUP BY 1"
SQL["search_scan"], SQL["index_stats"] = SQL["search_terms"], SQL["bm25_corpus_stats"]
_BIG = "(SELECT session_id FROM e GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)"
_CUT = f"(SELECT count(*) // 2 FROM e WHERE session_id = {_BIG})"
REQUESTS["_cursor"] = (Request("cursor"), "/", None)
SQL["search_session"] = _sql("_cursor").replace("WHERE tf_0 > 0", f"WHERE c.session_id = {_BIG} AND tf_0 > 0")
SQL["search_current_session"] = _sql("_cursor").replace("WHERE tf_0 > 0", f"WHERE c.session_id = {_BIG} AND ev.append_seq < {_CUT} AND tf_0 > 0")
SQL["search_other_sessions"] = SQL["search_all_hits"].replace("WHERE tf_0 > 0", f"WHERE c.session_id <> {_BIG} AND tf_0 > 0")
