"""Keeping a store up to date: what changed, what fits the budget, what is gone."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_within
from ..index import Index
from ..session import checkpointed
from ..sources.jsonl import Parsed, lines_of, listing, parse, read_headers, read_lines, source_info
from ..store import Store
from .project import to_store

#: What a start may read unless told otherwise.
START_BYTES, START_FILES = 32 * 1024 * 1024, 100
SAME, APPEND, REBUILD, NEW = "same", "append", "rebuild", "new"
_PAGE = 1_000
#: Files that a plan names one by one at most.
_LISTED = 10_000


def decision(previous: Column, current: Column) -> Column:
    """same, append or rebuild from two observations, structs of header_hash, entry_count, entry_hashes; new without a
    previous one. Another header, fewer entries or another prefix rebuild; entries after an empty file do, too."""
    n, m = previous["entry_count"], current["entry_count"]
    prefix = F.slice(current["entry_hashes"], F.lit(1), n) == F.slice(previous["entry_hashes"], F.lit(1), n)
    return (
        F.when(previous.isNull(), NEW)
        .when(~previous["header_hash"].eqNullSafe(current["header_hash"]) | (m < n), REBUILD)
        .when(n == 0, F.when(m == 0, SAME).otherwise(REBUILD))
        .when(~F.coalesce(prefix, F.lit(False)), REBUILD)
        .when(m > n, APPEND)
        .otherwise(SAME)
    )


def unchanged(previous: DataFrame, current: DataFrame) -> DataFrame:
    """file_path of files whose size and time are as before; their bodies needn't be read."""
    return current.join(previous, ["file_path", "size_bytes", "mtime_ms"], "left_semi").select("file_path").distinct()


def removed(previous: DataFrame, current: DataFrame, uncertain: DataFrame | None = None) -> DataFrame:
    """file_path of known files that are neither observed now nor uncertain (their headers can't be read)."""
    gone = previous.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")
    return gone if uncertain is None else gone.join(uncertain.select("file_path"), "file_path", "left_anti")


@dataclass(frozen=True)
class Coverage:
    """What a budget let in."""

    files: int
    bytes: int
    selected_files: int
    selected_bytes: int

    @property
    def limited(self) -> bool:
        return self.selected_files != self.files

    def notice(self) -> str:
        """One line for the reader of a limited result."""
        if not self.limited:
            return ""
        return f"only {self.selected_files} of {self.files} sessions ({mib(self.selected_bytes)} of {mib(self.bytes)}) are searched"


def mib(n: int) -> str:
    return f"{n / 1048576:.1f} MiB"


def read_budget(text: str | None, default: float) -> float:
    """A limit out of a setting: digits, or unlimited; the default for anything else."""
    if text is None:
        return default
    if text.strip().lower() == "unlimited":
        return math.inf
    return float(int(text)) if text.strip().isdigit() else default


def start_budget() -> tuple[float, float]:
    """(bytes, files) that a start may read."""
    return read_budget(os.environ.get("LOOMTRACE_START_BYTES"), START_BYTES), read_budget(os.environ.get("LOOMTRACE_START_FILES"), START_FILES)


def select_within(files: DataFrame, max_files: float, max_bytes: float) -> tuple[DataFrame, Coverage]:
    """The newest files (file_path, size_bytes, mtime_ms) that fit: newest first, ties by path, a file that doesn't
    fit is passed over and smaller ones after it may still come in.

    The files are sorted once, over all tasks, and running sums give the newest that fit together. Only what is smaller
    than the room that these leave comes to the driver, a page at a time. Without limits nothing is collected.
    """
    files = files.select("file_path", F.col("size_bytes").cast("long").alias("size_bytes"), F.coalesce(F.col("mtime_ms").cast("long"), F.lit(-(2**62))).alias("mtime_ms"))
    total = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    if math.isinf(max_files) and (math.isinf(max_bytes) or total[1] <= max_bytes):
        return files, Coverage(total[0], total[1], total[0], total[1])
    order = [F.col("mtime_ms").desc(), F.col("file_path")]
    placed = checkpointed(files.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))  # one row a task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "b")])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({"i": F.count("*").over(within), "sum": F.sum("size_bytes").over(within)}).join(sizes, "part")
    placed = checkpointed(placed.select("file_path", "size_bytes", "mtime_ms", (F.col("i") + F.col("n0")).alias("i"), (F.col("sum") + F.col("b0")).alias("sum")))
    fits = F.lit(True)
    if not math.isinf(max_files):
        fits = fits & (F.col("i") <= int(max_files))
    if not math.isinf(max_bytes):
        fits = fits & (F.col("sum") <= int(max_bytes))
    first = placed.filter(fits)
    n, used = first.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    more: list[tuple[str, int, int]] = []
    last = n
    while n + len(more) < max_files and not math.isinf(max_bytes):
        page = placed.filter((F.col("i") > last) & (F.col("size_bytes") <= int(max_bytes) - used)).orderBy("i").limit(_PAGE).collect()
        for r in page:
            if n + len(more) < max_files and r.size_bytes <= max_bytes - used:
                more.append((r.file_path, r.size_bytes, r.mtime_ms))
                used += r.size_bytes
        if len(page) < _PAGE:
            break
        last = page[-1].i
    out = first.select("file_path", "size_bytes", "mtime_ms")
    if more:
        out = out.unionByName(files.sparkSession.createDataFrame(more, "file_path string, size_bytes long, mtime_ms long"))
    return out, Coverage(total[0], total[1], n + len(more), used)


@dataclass
class Refresh:
    """What a refresh found: decisions by file, files that are gone, errors, coverage, the parsed bodies of the files
    that have to be indexed, and the sources of the good ones."""

    decisions: DataFrame
    gone: DataFrame
    errors: DataFrame
    coverage: Coverage
    parsed: Parsed
    sources: DataFrame


_KNOWN = "file_path string, size_bytes long, mtime_ms long, header_hash string, entry_count long, entry_hashes array<string>"


def refresh(spark: SparkSession, roots: list[str], known: DataFrame | None = None, root: str = "/", max_files: float = math.inf, max_bytes: float = math.inf) -> Refresh:
    """Compare the files below roots, whose sessions work in root, with what is known.

    known: file_path, size_bytes, mtime_ms, header_hash, entry_count, entry_hashes of the indexed files. Headers are
    read first; bodies only of selected files whose size or time changed. A file with an unreadable header is an
    error and not gone; a file whose body is bad is an error and what is known of it stays.
    """
    known = known if known is not None else spark.createDataFrame([], _KNOWN)
    heads = checkpointed(read_headers(spark, roots))
    bad = heads.filter("error IS NOT NULL").select("file_path", F.lit(None).cast("int").alias("line_no"), "error")
    mine = heads.filter("error IS NULL").filter(is_within("cwd", root)).select("file_path", "size_bytes", "mtime_ms")
    chosen, coverage = select_within(mine, max_files, max_bytes)
    return _compared(spark, known, chosen, bad, coverage, roots)


def _compared(spark: SparkSession, known: DataFrame, chosen: DataFrame, bad: DataFrame, coverage: Coverage, roots: list[str]) -> Refresh:
    same = unchanged(known, chosen)
    changed = checkpointed(chosen.join(same, "file_path", "left_anti"))
    if changed.count() <= _LISTED:
        lines = lines_of(spark, [r.file_path for r in changed.select("file_path").collect()])
    else:  # too many to name each in a plan
        lines = read_lines(spark, roots).join(changed.select("file_path"), "file_path", "left_semi")
    parsed = Parsed(*[checkpointed(x) for x in vars(parse(checkpointed(lines))).values()])
    sources = source_info(parsed).join(changed, "file_path")
    observation = F.struct("header_hash", "entry_count", "entry_hashes")
    now = sources.select("file_path", "session_id", observation.alias("current"))
    before = known.select("file_path", observation.alias("previous"))
    d = now.join(before, "file_path", "left").select("file_path", "session_id", decision(F.col("previous"), F.col("current")).alias("decision"))
    d = d.unionByName(same.select("file_path", F.lit(None).cast("string").alias("session_id"), F.lit(SAME).alias("decision")))
    return Refresh(d, removed(known, chosen, bad), bad.unionByName(parsed.errors.select("file_path", "line_no", "error")), coverage, parsed, sources)


@dataclass
class Maintainer:
    """Keeps an index in step with the session files below roots whose sessions work in root."""

    index: Index
    roots: list[str]
    root: str = "/"
    max_files: float = math.inf
    max_bytes: float = math.inf

    def start(self) -> tuple[DataFrame, Coverage]:
        """At a start or where root changes: all files within the budget. Sessions whose file is neither among them nor
        uncertain go. The report, and what the budget let in."""
        found = refresh(self.index.spark, self.roots, self.index.sources(), self.root, self.max_files, self.max_bytes)
        return self._applied(found, found.gone), found.coverage

    def turn(self, files: list[str]) -> DataFrame:
        """On a turn or call: these files alone (the current session's). The report."""
        spark = self.index.spark
        there = [(f, s.st_size, int(s.st_mtime * 1000)) for f in files if (s := _stat(f)) is not None]
        lost = [(f, None, "unreadable") for f in files if _stat(f) is None]
        chosen = spark.createDataFrame(there, "file_path string, size_bytes long, mtime_ms long")
        bad = spark.createDataFrame(lost, "file_path string, line_no int, error string")
        known = self.index.sources().join(chosen.select("file_path"), "file_path", "left_semi")
        found = _compared(spark, known, chosen, bad, Coverage(len(there), 0, len(there), 0), self.roots)
        return self._applied(found, None)

    def _applied(self, found: Refresh, gone: DataFrame | None) -> DataFrame:
        """Bring what was found into the index in one batch. The report: file_path, action (indexed, appended,
        unchanged, removed, error), session_id, error."""
        known = self.index.sources().select("file_path", F.col("session_id").alias("before"), F.col("entry_count").alias("n_before"))
        d = checkpointed(found.decisions.join(known, "file_path", "left"))
        work = d.filter(F.col("decision") != SAME)
        moved = work.filter("before IS NOT NULL AND before <> session_id").select(F.col("before").alias("session_id"))
        out = [] if gone is None else [checkpointed(gone.join(known, "file_path").select("file_path", F.col("before").alias("session_id")))]
        drop = moved
        for g in out:
            drop = drop.unionByName(g.select("session_id"))
        if not work.isEmpty():
            appended = work.filter((F.col("decision") == APPEND) & F.col("before").eqNullSafe(F.col("session_id"))).select("session_id", "n_before")
            store = only(to_store(found.parsed), work.select("session_id"))
            self.index.apply(store, appended, drop, found.sources.join(work.select("file_path"), "file_path", "left_semi"))
        elif not drop.isEmpty():
            self.index.apply(removed=drop)
        action = F.when(F.col("decision") == SAME, "unchanged").when(F.col("decision") == APPEND, "appended").otherwise("indexed")
        none = F.lit(None).cast("string")
        report = d.select("file_path", action.alias("action"), F.coalesce("session_id", "before").alias("session_id"), none.alias("error"))
        for g in out:
            report = report.unionByName(g.select("file_path", F.lit("removed").alias("action"), "session_id", none.alias("error")))
        bad = found.errors.join(known, "file_path", "left")
        return report.unionByName(bad.select("file_path", F.lit("error").alias("action"), F.col("before").alias("session_id"), "error"))


def only(store: Store, sessions: DataFrame) -> Store:
    """The part of a store that some sessions (session_id) make."""
    ids = sessions.select("session_id").distinct()
    return Store(*[None if x is None else x.join(ids, "session_id", "left_semi") for x in (store.sessions, store.entries, store.fragments, store.links, store.hashes)])


def _stat(path: str) -> os.stat_result | None:
    try:
        return os.stat(path)
    except OSError:
        return None


__all__ = ["Coverage", "Maintainer", "Refresh", "decision", "listing", "mib", "only", "read_budget", "refresh", "removed", "select_within", "start_budget", "unchanged"]
