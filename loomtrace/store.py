"""The searchable history: sessions, events and fragments as DataFrames, from tables or from JSONL files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.positions import dense_position
from .functions.text import INDEXED_CHARS, bounded_text, collapse
from .operators.tree import with_states
from .session import checkpointed
from .tables import Tables, latest_by

#: The role that the kinds of an entry's fragments tell.
KIND_ROLES = {"user.text": "user", "assistant.text": "assistant", "tool.call": "assistant", "tool.result": "tool", "bash.command": "tool", "bash.output": "tool", "summary.compaction": "summary", "summary.branch": "summary", "custom.message": "custom", "session.name": "metadata"}
FRAGMENT_COLUMNS = ["session_id", "entry_id", "fragment_id", "semantic_kind", "frag_text", "tool_name", "tool_call_id", "is_error", "custom_type", "file_paths", "file_evidence_type"]


@dataclass
class Store:
    """sessions: session_id, created_at, cwd, parent_session, session_name, file_path. entries: session_id, entry_id,
    append_seq (dense), parent_id, entry_ts, entry_type, entry_role, context_role, first_kept_id. fragments:
    FRAGMENT_COLUMNS and frag_ord. links: relationships that entries record. hashes: session_id, append_seq, hash.
    postings, sizes (fragments, tokens) and buckets come with a saved index; searches then read posting lists instead of texts."""

    sessions: DataFrame
    entries: DataFrame
    fragments: DataFrame
    links: DataFrame | None = None
    hashes: DataFrame | None = None
    _events: DataFrame | None = field(default=None, repr=False)
    postings: DataFrame | None = None
    sizes: tuple[int, int] | None = None
    buckets: int = 0

    @property
    def events(self) -> DataFrame:
        """entries with branch and selection states, computed once."""
        if self._events is None:
            self._events = with_states(self.entries)
        return self._events


def frag_ord(fragment_id: Column) -> Column:
    """Place of a fragment among those of its kind, out of its id entry::kind::place; 0 if it has none."""
    return F.coalesce(F.regexp_extract(fragment_id, r"::(\d{1,9})$", 1).try_cast("int"), F.lit(0))


def fragments_of(df: DataFrame) -> DataFrame:
    """Rows of a fragments table, exact repetitions once, with their place.

    Repetitions are told by 128 bits of hash, so that texts travel only where they are asked for.
    """
    f = df.filter("session_id IS NOT NULL AND entry_id IS NOT NULL AND frag_text IS NOT NULL").select(*FRAGMENT_COLUMNS)
    f = f.withColumns({"__a": F.xxhash64(*FRAGMENT_COLUMNS), "__b": F.xxhash64(F.lit(7), *FRAGMENT_COLUMNS)})
    f = f.dropDuplicates(["session_id", "entry_id", "__a", "__b"]).drop("__a", "__b")
    return f.withColumn("frag_ord", frag_ord(F.col("fragment_id")))


def index_text(limit: int = INDEXED_CHARS) -> Column:
    """What of a fragment is indexed."""
    return bounded_text(F.col("frag_text"), limit)


def from_tables(t: Tables) -> Store:
    """The store of the tables sessions, entries and fragments; of repeated headers and entries the latest counts."""
    sessions = latest_by(t.sessions.filter("session_id IS NOT NULL"), ["session_id"], "ingested_at", ["created_at", "cwd", "parent_session", "session_name", "file_path"])
    columns = ["append_seq", "parent_id", "entry_ts", "entry_type", "entry_role", "context_role"]
    e = latest_by(t.entries.filter("session_id IS NOT NULL AND entry_id IS NOT NULL"), ["session_id", "entry_id"], "ingested_at", columns)
    e = dense_position(e.withColumnRenamed("append_seq", "log_seq"), "session_id", "log_seq", "entry_id", "append_seq").drop("log_seq")
    return Store(sessions, e.withColumn("first_kept_id", F.lit(None).cast("string")), fragments_of(t.fragments))


def session_names(store: Store) -> DataFrame:
    """session_id, session_name: the first session.name fragment of each session in log order."""
    f = store.fragments.filter("semantic_kind = 'session.name'").select("session_id", "entry_id", "frag_ord", collapse("frag_text").alias("name"))
    f = f.filter("name <> ''").join(store.entries.select("session_id", "entry_id", "append_seq"), ["session_id", "entry_id"])
    return f.groupBy("session_id").agg(F.min_by("name", F.struct("append_seq", "frag_ord")).alias("session_name"))


def cached(store: Store) -> Store:
    """The store with all its tables written to the shared checkpoint folder, for many small reads."""
    tables = {n: None if getattr(store, n) is None else checkpointed(getattr(store, n)) for n in ("sessions", "entries", "fragments", "links", "hashes")}
    out = Store(**tables)
    out._events = checkpointed(out.events)
    return out
