"""Ranked full-text search over fragments that returns events."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotFound
from ..functions.paths import is_within
from ..functions.text import snippet
from ..functions.tokens import Query, frequency, parse_query, tokens
from ..store import Store, index_text

#: Weights of the ranking function and the tools whose traffic searches leave out.
K1, B = 1.2, 0.75
OWN_TOOLS = ("event_search", "event_read", "event_trace")
LIMIT = 20


@dataclass(frozen=True)
class Request:
    """What to search for; an empty or missing filter filters nothing."""

    query: str
    session_id: str | None = None
    cwd: str | None = None
    kinds: Sequence[str] = ()
    tool_names: Sequence[str] = ()
    entry_types: Sequence[str] = ()
    roles: Sequence[str] = ()
    time_from: str | None = None
    time_to: str | None = None
    branch_states: Sequence[str] = ()
    selection_states: Sequence[str] = ()
    error_only: bool = False


@dataclass(frozen=True)
class Execution:
    """The session that asks, and where it stands."""

    current_session_id: str | None = None
    invocation_entry_id: str | None = None
    invocation_timestamp: str | None = None


@dataclass(frozen=True)
class Statistics:
    """Numbers over the whole index: fragments, mean number of tokens, fragments that hold each sequence."""

    n: int
    mean: float
    having: dict[tuple[str, ...], int] = field(default_factory=dict)


def tokenized(fragments: DataFrame) -> DataFrame:
    """fragments with their indexed tokens."""
    return fragments.withColumn("tokens", tokens(index_text()))


def statistics(fragments: DataFrame, sequences: Sequence[tuple[str, ...]]) -> DataFrame:
    """One row: n, mean, and df_0, df_1, ... for the sequences, over all fragments, before any filter."""
    t = tokenized(fragments.select("frag_text"))
    parts = [F.sum((frequency(F.col("tokens"), s) > 0).cast("long")).alias(f"df_{i}") for i, s in enumerate(sequences)]
    return t.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"), *parts)


def read_statistics(fragments: DataFrame, sequences: Sequence[tuple[str, ...]]) -> Statistics:
    """The row of statistics() on the driver."""
    own = list(dict.fromkeys(sequences))
    r = statistics(fragments, own).first()
    return Statistics(r["n"], r["mean"] or 0.0, {s: r[f"df_{i}"] or 0 for i, s in enumerate(own)})


def weight(n: int, having: int) -> float:
    """Inverse document frequency, tiny for what most fragments hold."""
    value = math.log((n - having + 0.5) / (having + 0.5))
    return value if value > 0 else 1e-6


def score(tf: Sequence[Column], length: Column, q: Query, s: Statistics) -> Column:
    """BM25 as a negative number: the least is the best."""
    norm = K1 * (1 - B + B * length / F.lit(s.mean or 1.0))
    total = F.lit(0.0)
    for f, sequence in zip(tf, q.sequences):
        total = total + F.lit(weight(s.n, s.having[sequence])) * (f * (K1 + 1)) / (f + norm)
    return -total


def authorized(store: Store, root: str) -> DataFrame:
    """The sessions whose working folder lies in root."""
    return store.sessions.filter(is_within("cwd", root))


def cutoff_seq(store: Store, session_id: str, execution: Execution) -> int:
    """The place in the log before which the asking session may see its own entries: that of its invocation entry,
    else of the first entry, in log order, stamped at or after the invocation, else the end."""
    own = store.entries.filter(F.col("session_id") == session_id)
    if execution.invocation_entry_id is not None:
        r = own.filter(F.col("entry_id") == execution.invocation_entry_id).select("append_seq").first()
        if r is not None:
            return r[0]
    if execution.invocation_timestamp is None:
        raise InvalidArgument("reading the current session needs a cutoff")
    r = cutoffs(own, execution.invocation_timestamp).first()
    return r["cutoff"] if r is not None else 0


def cutoffs(entries: DataFrame, timestamp: str) -> DataFrame:
    """session_id, cutoff: for every session, the place in its log before which it might see its own entries if it asked
    at the time (in the form of the entries' stamps)."""
    late = F.min(F.when(F.col("entry_ts") >= timestamp, F.col("append_seq")))
    return entries.groupBy("session_id").agg(F.coalesce(late, F.count("*")).alias("cutoff"))


def fragment_filter(r: Request) -> Column:
    """What a request asks of fragments, pushed to their scan."""
    c = F.lit(True)
    if r.kinds:
        c = c & F.col("semantic_kind").isin(*r.kinds)
    if r.tool_names:
        c = c & F.col("tool_name").isin(*r.tool_names)
    else:
        c = c & ~F.coalesce("tool_name", F.lit("")).isin(*OWN_TOOLS)
    if r.error_only:
        c = c & F.coalesce("is_error", F.lit(False))
    if r.session_id is not None:
        c = c & (F.col("session_id") == r.session_id)
    return c


def event_filter(r: Request) -> Column:
    """What a request asks of events."""
    c = F.lit(True)
    for column, values in (("entry_type", r.entry_types), ("entry_role", r.roles), ("branch_state", r.branch_states), ("selection_state", r.selection_states)):
        if values:
            c = c & F.col(column).isin(*values)
    if r.time_from is not None:
        c = c & (F.col("entry_ts") >= r.time_from)
    if r.time_to is not None:
        c = c & (F.col("entry_ts") <= r.time_to)
    return c


def matches(store: Store, q: Query, r: Request) -> DataFrame:
    """The fragments that pass the request's fragment filters and hold every sequence: session_id, entry_id,
    fragment_id, semantic_kind, tool_name, is_error, frag_ord, tf_0.., score; frag_text too where texts were read."""
    if store.postings is not None:
        return _listed(store, q, r)
    s = read_statistics(store.fragments, q.sequences)
    cheap = F.lit(True)
    for sequence in q.sequences:  # ASCII tokens of plain texts can be looked for before anything is cut into tokens
        for token in sequence:
            if token.isascii():
                cheap = cheap & (F.col("frag_text").rlike(r"[^\x00-\x7F]") | F.contains(F.lower("frag_text"), F.lit(token)))
    f = tokenized(store.fragments.filter(fragment_filter(r)).filter(cheap))
    tf = [frequency(F.col("tokens"), x) for x in q.sequences]
    f = f.withColumns({f"tf_{i}": x for i, x in enumerate(tf)})
    for i in range(len(tf)):
        f = f.filter(F.col(f"tf_{i}") > 0)
    return f.withColumn("score", score([F.col(f"tf_{i}") for i in range(len(tf))], F.size("tokens"), q, s)).drop("tokens")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def lists(store: Store, sequences: Sequence[tuple[str, ...]]) -> DataFrame:
    """The fragments that hold a token of the sequences, out of its posting list, with tf_0.. of the sequences. Only
    the lists' buckets are read."""
    want = list(dict.fromkeys(t for s in sequences for t in s))
    buckets = sorted({zlib.crc32(t.encode()) % store.buckets for t in want})
    p = store.postings.filter(F.col("tb").isin(*buckets) & F.col("token").isin(*want))
    keep = ["entry_id", "fragment_id", "semantic_kind", "tool_name", "is_error", "frag_ord", "n_tokens"]
    at = {t: f"at_{i}" for i, t in enumerate(want)}
    if len(want) == 1:
        p = p.select("session_id", "fk", *keep, F.col("positions").alias("at_0"))
    else:
        p = p.groupBy("session_id", "fk").agg(*[F.first(c).alias(c) for c in keep], *[F.max(F.when(F.col("token") == t, F.col("positions"))).alias(c) for t, c in at.items()])

    def places(sequence: tuple[str, ...]) -> Column:
        out = F.col(at[sequence[0]])
        for k, t in enumerate(sequence[1:], 1):
            out = F.array_intersect(out, _moved(F.col(at[t]), k))
        return F.coalesce(F.size(out), F.lit(0))

    p = p.withColumns({f"tf_{i}": F.when(places(s).isNull() | (places(s) < 0), 0).otherwise(places(s)) for i, s in enumerate(sequences)})
    return p.drop(*at.values())


def _listed(store: Store, q: Query, r: Request) -> DataFrame:
    """matches() out of posting lists."""
    own = list(dict.fromkeys(q.sequences))
    hits = lists(store, own)
    having = hits.agg(*[F.coalesce(F.sum((F.col(f"tf_{i}") > 0).cast("long")), F.lit(0)).alias(f"df_{i}") for i in range(len(own))]).first()
    n, total = store.sizes
    s = Statistics(n, total / n if n else 0.0, {x: having[f"df_{i}"] for i, x in enumerate(own)})
    f = hits.filter(fragment_filter(r))
    for i in range(len(own)):
        f = f.filter(F.col(f"tf_{i}") > 0)
    f = f.withColumns({f"tf_{i}": F.col(f"tf_{own.index(x)}") for i, x in enumerate(q.sequences)})
    return f.withColumn("score", score([F.col(f"tf_{i}") for i in range(len(q.sequences))], F.col("n_tokens"), q, s)).drop("n_tokens")


#: The columns of a hit.
HIT = ["session_id", "session_name", "cwd", "entry_id", "entry_type", "fragment_id", "semantic_kind", "entry_ts", "branch_state", "selection_state", "snippet", "n_fragments", "score"]


def search(store: Store, r: Request, root: str = "/", execution: Execution | None = None, limit: int | None = LIMIT) -> DataFrame:
    """The best events, one row each, ordered: HIT's columns. limit None gives every event that matches.

    Fragments rank, events are returned: the event's best fragment stands for it, n_fragments counts all that match.
    Ties go to (session_id, append_seq, kind, place). A query without any token has no hits. A session that isn't
    there or lies outside root raises NotFound before anything is searched.
    """
    q = parse_query(r.query)
    allowed = authorized(store, root)
    if r.session_id is not None and allowed.filter(F.col("session_id") == r.session_id).isEmpty():
        raise NotFound(f"session {r.session_id}")
    if r.cwd is not None:
        allowed = allowed.filter(is_within("cwd", r.cwd))
    if not q.sequences:
        return store.sessions.sparkSession.createDataFrame([], "session_id string, session_name string, cwd string, entry_id string, entry_type string, fragment_id string, semantic_kind string, entry_ts string, branch_state string, selection_state string, snippet string, n_fragments long, score double")
    events = store.events.filter(event_filter(r))
    current = execution.current_session_id if execution else None
    if current is not None:
        mine = F.col("session_id") == current
        events = events.filter(~mine | (F.col("append_seq") < cutoff_seq(store, current, execution)) if r.session_id == current else ~mine)
    f = matches(store, q, r).join(events.select("session_id", "entry_id", "entry_type", "entry_ts", "branch_state", "selection_state", "append_seq"), ["session_id", "entry_id"])
    f = f.join(allowed.select("session_id", "session_name", "cwd"), "session_id")
    rank = F.struct("score", "semantic_kind", "frag_ord", "fragment_id")
    keep = ["session_name", "cwd", "entry_type", "entry_ts", "branch_state", "selection_state", "append_seq"]
    of = "fk" if store.postings is not None else "frag_text"
    best = f.groupBy("session_id", "entry_id").agg(
        F.min_by(F.struct("fragment_id", "semantic_kind", of, "score", "frag_ord"), rank).alias("b"), F.count("*").alias("n_fragments"), *[F.first(c).alias(c) for c in keep]
    )
    order = [F.col("score"), "session_id", "append_seq", "semantic_kind", "frag_ord"]
    best = best.select("session_id", "entry_id", "n_fragments", *keep, "b.*")
    if limit is not None:
        best = best.orderBy(*order).limit(limit)
    if of == "fk":
        best = _with_texts(store, best, limit)
    text = snippet(F.col("frag_text"), [*q.terms, *q.phrases])
    best = best.orderBy(*order)
    return best.select("session_id", "session_name", "cwd", "entry_id", "entry_type", "fragment_id", "semantic_kind", "entry_ts", "branch_state", "selection_state", text.alias("snippet"), "n_fragments", "score")


def _with_texts(store: Store, best: DataFrame, limit: int | None) -> DataFrame:
    """The hits with frag_text. A limited number of hits comes to the driver, so that only their sessions' parts of the
    fragments are read."""
    texts = store.fragments.select("session_id", "fk", "frag_text")
    if limit is not None:
        rows = best.collect()
        best = store.sessions.sparkSession.createDataFrame(rows, best.schema)
        texts = texts.filter(F.col("session_id").isin(*{r.session_id for r in rows}) & F.col("fk").isin(*{r.fk for r in rows})) if rows else texts.filter("false")
    return best.join(texts, ["session_id", "fk"])
