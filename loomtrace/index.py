"""The saved index: a store with posting lists that sessions are added to, appended to, replaced in and removed from.

Each change is a batch: folders of rows under the index, made part of it by one numbered commit. A commit also names the
table of live sessions: since which batch a session's fragments count (an append leaves that alone, a replacement moves
it), which batch holds its header, events, links and hashes (all of which follow from the whole session), and its share
of the ranking's statistics. So appending writes new fragments only, removing writes none, and readers see a batch whole
or not at all. compact() writes what is live as one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.commits import CommitLog
from .functions.tokens import tokens
from .operators.incremental import Conflict
from .session import checkpointed
from .store import FRAGMENT_COLUMNS, Store, index_text

#: Buckets of posting lists by token (of an index that names no other number), and parts of a bucket by fragment, so that no token's list is one task's.
BUCKETS, PARTS = 32, 8
_POSTING = "session_id string, entry_id string, fragment_id string, semantic_kind string, tool_name string, is_error boolean, frag_ord int, fk long, n_tokens int, token string, positions array<int>"
_KEPT = ["session_id", "entry_id", "fragment_id", "semantic_kind", "tool_name", "is_error", "frag_ord", "fk"]
_WHOLE = ("sessions", "events", "links", "hashes", "sources")
_LIVE = "session_id string, base int, at int, n_fragments long, n_tokens long"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def with_key(fragments: DataFrame) -> DataFrame:
    """fragments with fk, a hash of the whole row: two fragments of an entry may bear the same id."""
    return fragments.withColumn("fk", F.xxhash64(*[F.to_json(c) if c == "file_paths" else c for c in FRAGMENT_COLUMNS]))


def postings_of(fragments: DataFrame) -> DataFrame:
    """A row for each token of each fragment (with fk): its positions, and what searches filter and rank by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat = lists.flatten()
            if not len(flat):
                continue
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            words = flat.dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            o = np.argsort(row * len(words.dictionary) + code, kind="stable")
            row, code, place = row[o], code[o], place[o]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
            at = pa.array(row[first])
            columns = [b.column(c).take(at) for c in _KEPT]
            columns += [pa.array(size[row[first]].astype(np.int32)), words.dictionary.take(pa.array(code[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place))]
            for piece in pa.Table.from_arrays(columns, names=[*_KEPT, "n_tokens", "token", "positions"]).to_batches(max_chunksize=50_000):
                yield piece

    return fragments.select(*_KEPT, tokens(index_text()).alias("tokens")).mapInArrow(run, _POSTING)


def sessions_of(store: Store) -> DataFrame:
    """session_id of all sessions that a store has rows of, with a header or without."""
    every = [x.select("session_id").distinct() for x in (store.sessions, store.entries, store.fragments)]
    return every[0].unionByName(every[1]).unionByName(every[2]).distinct()


class Index:
    """Committed batches under a folder: ``{table}/{batch}-{attempt}`` holds a batch's rows of a table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        """buckets: of a new index; one that is there keeps its own."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = CommitLog(spark, self.root)

    # reading

    def _state(self) -> tuple[int, dict[str, Any]]:
        """The number of the last commit and what it says; batches: those that hold live rows, with their tables."""
        last = (self.log.numbers() or [0])[-1]
        return last, self.log.read(last) if last else {"batches": {}, "live": None, "n_fragments": 0, "n_tokens": 0, "buckets": self.buckets}

    def _live(self, state: dict[str, Any]) -> DataFrame:
        if state["live"] is None:
            return self.spark.createDataFrame([], _LIVE)
        return self.spark.read.schema(_LIVE).parquet(f"{self.root}/live/{state['live']}")

    def _table(self, state: dict[str, Any], table: str) -> DataFrame | None:
        """A table's live rows."""
        folders = [f"{self.root}/{table}/batch={b}" for b, tables in sorted(state["batches"].items()) if table in tables]
        if not folders:
            return None
        df = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*folders)
        n = F.split_part("batch", F.lit("-"), F.lit(1)).cast("int")
        if len(state["batches"]) == 1 and state.get("whole"):
            return df.drop("batch")
        live = self._live(state).select("session_id", "base" if table in ("fragments", "postings") else "at")
        rows = df.withColumn("__n", n).drop("batch").join(live, "session_id")
        return (rows.filter("__n >= base") if table in ("fragments", "postings") else rows.filter("__n = at")).drop("__n", "base", "at")

    def store(self) -> Store:
        """The index as a store, as of now: later changes don't touch it."""
        _, state = self._state()
        t = {x: self._table(state, x) for x in (*_WHOLE, "fragments", "postings")}
        if t["sessions"] is None:
            raise FileNotFoundError(f"no index in {self.root}")
        entries = t["events"].drop("branch_state", "selection_state", "back", "n_children", "next_id")
        return Store(t["sessions"], entries, t["fragments"], t["links"], t["hashes"], t["events"], t["postings"], (state["n_fragments"], state["n_tokens"]), state["buckets"])

    def sources(self) -> DataFrame:
        """file_path, session_id, size_bytes, mtime_ms, header_hash, entry_count, entry_hashes of the live sessions'
        files."""
        t = self._table(self._state()[1], "sources")
        return self.spark.createDataFrame([], SOURCES) if t is None else t.select(*[c.split()[0] for c in SOURCES.split(", ")])

    def live_sessions(self) -> DataFrame:
        """session_id of the sessions in the index."""
        return self._live(self._state()[1]).select("session_id")

    # writing

    def apply(self, store: Store | None = None, appended: DataFrame | None = None, removed: DataFrame | None = None, sources: DataFrame | None = None, replace_all: bool = False) -> int:
        """One batch: the sessions of store come in, in place of what is there of them; of those in appended
        (session_id, n_before) only the entries from n_before on are new; the sessions in removed (session_id) go, and
        with replace_all all that aren't in store. sources: the files of the sessions in store. The batch's number.

        Either all of it becomes part of the index or nothing. Conflict is raised, and nothing changed, where another
        writer was first: its batch may bear on what is to be done.
        """
        last, state = self._state()
        n = last + 1
        name = f"{n}-{uuid.uuid4().hex}"
        live = self._live(state)
        tables: list[str] = []
        rows = live.filter("false") if replace_all else live
        if removed is not None:
            rows = rows.join(removed.select("session_id").distinct(), "session_id", "left_anti")
        if store is not None:
            old = rows.join(appended.select("session_id", "n_before"), "session_id") if appended is not None else None
            tables = self._write(name, state["buckets"], store, old, sources)
            rows = rows.join(sessions_of(store), "session_id", "left_anti").unionByName(self._sizes(name, n, store, old, tables))
        live_name = f"{n}-{uuid.uuid4().hex}"
        rows.select("session_id", "base", "at", "n_fragments", "n_tokens").write.parquet(f"{self.root}/live/{live_name}")
        now = self.spark.read.schema(_LIVE).parquet(f"{self.root}/live/{live_name}")
        total = now.agg(F.count("*"), F.coalesce(F.sum("n_fragments"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.min("base"), F.min("at")).first()
        batches = {} if replace_all else dict(state["batches"])
        if tables:
            batches[name] = tables
        used = {int(b.split("-")[0]) for b in batches}
        if total[3] is not None:  # batches older than anything live hold nothing that counts
            batches = {b: t for b, t in batches.items() if int(b.split("-")[0]) >= min(total[3], total[4])}
        whole = bool(tables) and len(batches) == 1 and used == {n}
        payload = {"batches": batches, "live": live_name, "n_fragments": total[1], "n_tokens": total[2], "whole": whole, "buckets": state["buckets"]}
        if not self.log.publish(n, payload):
            for t in tables:
                self.log.delete(f"{self.root}/{t}/batch={name}")
            self.log.delete(f"{self.root}/live/{live_name}")
            raise Conflict("another batch came first")
        return n

    def _write(self, name: str, buckets: int, store: Store, old: DataFrame | None, sources: DataFrame | None) -> list[str]:
        """Write the store's rows; of sessions in old only their new fragments. The tables written."""
        out = []
        for table, df in (("sessions", store.sessions), ("events", store.events), ("links", store.links), ("hashes", store.hashes), ("sources", sources)):
            if df is not None:
                df.repartition("session_id").sortWithinPartitions("session_id").write.parquet(f"{self.root}/{table}/batch={name}")
                out.append(table)
        f = store.fragments
        if old is not None:
            seen = store.entries.join(old.select("session_id", "n_before"), "session_id").filter("append_seq < n_before").select("session_id", "entry_id")
            f = f.join(seen, ["session_id", "entry_id"], "left_anti")
        spread = F.pmod(F.xxhash64("session_id", "entry_id"), F.lit(PARTS))  # a session may hold a large part of all rows
        f = with_key(f)
        f.repartition("session_id", spread).sortWithinPartitions("session_id", "entry_id").write.parquet(f"{self.root}/fragments/batch={name}")
        p = postings_of(self.spark.read.parquet(f"{self.root}/fragments/batch={name}"))
        p = p.withColumn("tb", bucket_of(F.col("token"), buckets))
        p = p.repartition(F.col("tb"), F.pmod("fk", F.lit(PARTS))).sortWithinPartitions("tb", "token", "session_id")
        p.write.partitionBy("tb").parquet(f"{self.root}/postings/batch={name}")
        return [*out, "fragments", "postings"]

    def _sizes(self, name: str, n: int, store: Store, old: DataFrame | None, tables: list[str]) -> DataFrame:
        """The live rows of the store's sessions."""
        f = self.spark.read.parquet(f"{self.root}/fragments/batch={name}").groupBy("session_id").agg(F.count("*").alias("f"))
        p = self.spark.read.schema(_POSTING).parquet(f"{self.root}/postings/batch={name}").groupBy("session_id").agg(F.sum(F.size("positions")).alias("t"))
        s = sessions_of(store).join(f, "session_id", "left").join(p, "session_id", "left")
        f, t = F.coalesce("f", F.lit(0)), F.coalesce("t", F.lit(0))
        if old is None:
            return s.select("session_id", F.lit(n).alias("base"), F.lit(n).alias("at"), f.alias("n_fragments"), t.alias("n_tokens"))
        s = s.join(old.select("session_id", F.col("base").alias("b"), F.col("n_fragments").alias("of"), F.col("n_tokens").alias("ot")), "session_id", "left")
        return s.select("session_id", F.coalesce("b", F.lit(n)).alias("base"), F.lit(n).alias("at"), (f + F.coalesce("of", F.lit(0))).alias("n_fragments"), (t + F.coalesce("ot", F.lit(0))).alias("n_tokens"))

    def delete(self, session_ids: Sequence[str]) -> int:
        """Remove the rows of sessions."""
        return self.apply(removed=self.spark.createDataFrame([(x,) for x in session_ids], "session_id string"))

    def compact(self) -> int:
        """What is live, as one batch."""
        s, sources = self.store(), self.sources()
        s = Store(*[None if x is None else checkpointed(x) for x in (s.sessions, s.entries, s.fragments.drop("fk"), s.links, s.hashes, s.events)])
        return self.apply(s, sources=checkpointed(sources), replace_all=True)

    def sweep(self) -> list[str]:
        """Remove, and return, the folders of batches up to the last that it doesn't name."""
        last, state = self._state()
        kept = {f"batch={b}" for b in state["batches"]} | {state["live"]}
        lost = []
        for table in self.log.children(self.root):
            for x in self.log.children(f"{self.root}/{table}") if table != "commits" else []:
                number = x.removeprefix("batch=").split("-")[0]
                if x not in kept and number.isdigit() and int(number) <= last:
                    self.log.delete(f"{self.root}/{table}/{x}")
                    lost.append(f"{table}/{x}")
        return lost


SOURCES = "file_path string, session_id string, size_bytes long, mtime_ms long, header_hash string, entry_count long, entry_hashes array<string>"
