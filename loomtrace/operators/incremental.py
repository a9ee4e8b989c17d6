"""Only new or changed records: observations against a manifest of what was processed, and a run that survives failures.

A manifest row names a file, its size and checksum, and the hashes of its processed entries. A run anti-joins its
listing with the manifest, writes its output into a folder of its batch number and attempt, and commits the manifest
last, in one step that names both. A run that dies before the commit leaves folders that no reader sees; of two runs
that prepared the same batch one commits, and the other starts over from what that one committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.commits import CommitLog
from ..session import checkpointed


def is_durable(h: Column) -> Column:
    """The hash stands for content: eight lower-case hex digits. Placeholders never do."""
    return F.coalesce(h.rlike(r"^[0-9a-f]{8}\z"), F.lit(False))


def changed_places(current: Column, done: Column) -> Column:
    """Zero-based places of current whose hash isn't durably equal to the one at the same place of done (or null)."""
    done = F.coalesce(done, F.array().cast("array<string>"))

    def differs(h: Column, i: Column) -> Column:
        return F.when(is_durable(h) & F.coalesce(F.get(done, i) == h, F.lit(False)), None).otherwise(i.cast("int"))

    return F.array_compact(F.transform(F.coalesce(current, F.array().cast("array<string>")), differs))


def with_checksum(listing: DataFrame) -> DataFrame:
    """listing with the checksum of each file's entry_hashes; null lists count as empty ones."""
    hashes = F.coalesce("entry_hashes", F.array().cast("array<string>"))
    return listing.withColumn("checksum", F.sha2(F.to_json(hashes), 256))


def unprocessed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of listing (file_path, entry_hashes, other columns) that the manifest (file_path, checksum,
    entry_hashes; one row per file) doesn't hold as they are, with checksum and places, the entries to process.

    Files with a hash that isn't durable are never held. places is empty for files that only lost entries.
    """
    held = manifest.filter(F.forall(F.coalesce("entry_hashes", F.array().cast("array<string>")), is_durable)).select("file_path", "checksum")
    todo = with_checksum(listing).join(held, ["file_path", "checksum"], "left_anti")
    todo = todo.join(manifest.select("file_path", F.col("entry_hashes").alias("__done")), "file_path", "left")
    return todo.withColumn("places", changed_places(F.col("entry_hashes"), F.col("__done"))).drop("__done")


def observed(observations: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file_path, size_bytes, entry_hashes as the current run lists them, and as the latest earlier run with state ok
    that saw the file left them.

    observations: run_id, file_path, size_bytes, entry_hashes, observed_at; of several in a run the latest counts
    (ties: the greatest list). runs: run_id, run_state; the greatest run_id is the current run. Rows with a null run
    or path are left out; without runs there is no current run and both tables are empty.
    """
    r = runs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.coalesce(F.col("run_state") == "ok", F.lit(False))).alias("ok"))
    r = r.withColumn("last", F.max("run_id").over(Window.partitionBy()))  # one row per run of the indexer
    r = r.filter("ok OR run_id = last").select("run_id", (F.col("run_id") == F.col("last")).alias("now"))
    size = F.col("size_bytes").cast("long") if "size_bytes" in observations.columns else F.lit(None).cast("long")
    seen = observations.filter("file_path IS NOT NULL").select("run_id", "file_path", size.alias("size_bytes"), "entry_hashes", "observed_at")
    seen = seen.join(r, "run_id").groupBy("file_path", "run_id", "now").agg(F.max(F.struct(F.col("observed_at").isNotNull(), "observed_at", "entry_hashes", "size_bytes")).alias("o"))
    now = seen.filter("now").select("file_path", "o.size_bytes", "o.entry_hashes")
    done = seen.filter("NOT now").groupBy("file_path").agg(F.max(F.struct("run_id", F.col("o.size_bytes").alias("size_bytes"), F.col("o.entry_hashes").alias("entry_hashes"))).alias("d"))
    return now, done.select("file_path", "d.size_bytes", "d.entry_hashes")


def places_of(todo: DataFrame) -> DataFrame:
    """file_path, entry_no of the entries to process."""
    return todo.select("file_path", F.explode("places").alias("entry_no"))


def pending_entries(observations: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """file_path, entry_no of the entries that the current run has to process, as its committed batch holds them.

    What earlier runs finished is committed to a manifest under folder, a new folder of this call's own; then the
    current run's listing goes through run_once. Sizes and times aren't trusted: checksums and hashes decide. A null
    list holds no entries. Observations and runs as in observed().
    """
    spark = observations.sparkSession
    now, done = observed(observations, runs)
    manifest = Manifest(spark, f"{folder}/manifest")
    manifest.commit(1, with_checksum(done), None)
    number = run_once(spark, now, places_of, f"{folder}/out", manifest)
    if number is None:
        return spark.createDataFrame([], "file_path string, entry_no int")
    return read_committed(spark, manifest, number).select("file_path", "entry_no")


class Manifest:
    """Committed batches under a folder: ``files/{attempt}`` holds the files that a batch processed, its commit names
    that folder and the batch's output. Every snapshot_every batches the commit also names a folder with the latest
    row of every file, so that readers need not go back further."""

    COLUMNS = "file_path string, size_bytes long, checksum string, entry_hashes array<string>"

    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = 16) -> None:
        self.spark, self.root, self.snapshot_every = spark, root.rstrip("/"), snapshot_every
        self.log = CommitLog(spark, self.root)

    def batches(self) -> list[int]:
        """Numbers of the committed batches, ascending."""
        return self.log.numbers()

    def _since_snapshot(self, last: int) -> tuple[list[tuple[int, dict]], list[tuple[int, dict]]]:
        """Commits after the latest snapshot, newest first, and the snapshot's own (or none)."""
        after: list[tuple[int, dict]] = []
        for n in range(last, 0, -1):
            c = self.log.read(n)
            if c.get("snapshot"):
                return after, [(n, c)]
            after.append((n, c))
        return after, []

    def state(self) -> tuple[int, DataFrame]:
        """The number of the last batch, and the latest committed row of each file as of that batch."""
        last = (self.batches() or [0])[-1]
        after, whole = self._since_snapshot(last)
        folders = [(n, c["files"]) for n, c in after] + [(n, c["snapshot"]) for n, c in whole]
        if not folders:
            return last, self.spark.createDataFrame([], self.COLUMNS)
        parts = [self.spark.read.schema(self.COLUMNS).parquet(f"{self.root}/{f}").withColumn("batch", F.lit(n)) for n, f in folders]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        if len(parts) == 1:
            return last, every.drop("batch")
        latest = F.max_by(F.struct("size_bytes", "checksum", "entry_hashes"), F.col("batch")).alias("m")
        return last, every.groupBy("file_path").agg(latest).select("file_path", "m.*")

    def files(self) -> DataFrame:
        """The latest committed row of each file."""
        return self.state()[1]

    def outputs(self) -> list[tuple[int, str]]:
        """Number and output folder of each committed batch that wrote one."""
        after, whole = self._since_snapshot((self.batches() or [0])[-1])
        old = [tuple(x) for _, c in whole for x in c["outputs"]]
        return sorted(old + [(n, c["output"]) for n, c in after if c.get("output")])

    def commit(self, number: int, rows: DataFrame, output: str | None, attempt: str | None = None) -> bool:
        """Make rows (new or changed files) and the output part of the manifest as batch number, in one step; False,
        and nothing is part of it, where another run has committed a batch of that number."""
        attempt = attempt or f"{number:08d}-{uuid.uuid4().hex}"
        rows.select("file_path", F.col("size_bytes").cast("long").alias("size_bytes"), "checksum", "entry_hashes").write.parquet(f"{self.root}/files/{attempt}")
        payload = {"files": f"files/{attempt}", "output": output}
        if number > 1:
            after, _ = self._since_snapshot(number - 1)
            if len(after) + 1 >= self.snapshot_every:
                outputs = self.outputs() + ([(number, output)] if output else [])
                whole = rows.select(*self.files().columns)
                whole.unionByName(self.files().join(rows.select("file_path"), "file_path", "left_anti")).write.parquet(f"{self.root}/files/{attempt}-all")
                payload |= {"snapshot": f"files/{attempt}-all", "outputs": outputs}
        if self.log.publish(number, payload):
            return True
        for folder in (f"files/{attempt}", f"files/{attempt}-all"):
            self.log.delete(f"{self.root}/{folder}")
        return False

    def sweep(self, out: str) -> list[str]:
        """Remove, and return, the attempts below out that no commit names and no run can commit any more: those of
        batches up to the last one."""
        last = (self.batches() or [0])[-1]
        kept = {f.rsplit("/", 1)[-1] for _, f in self.outputs()}
        lost = [n for n in self.log.children(out) if n not in kept and n.split("-")[0].isdigit() and int(n.split("-")[0]) <= last]
        for n in lost:
            self.log.delete(f"{out.rstrip('/')}/{n}")
        return lost


class Conflict(OSError):
    """Other runs were first each time."""


def listed(listing: DataFrame) -> DataFrame:
    """One row per file: of several the one with the greatest size, then list. Rows without path are left out."""
    top = F.max(F.struct("size_bytes", "entry_hashes")).alias("o")
    return listing.filter("file_path IS NOT NULL").groupBy("file_path").agg(top).select("file_path", "o.size_bytes", "o.entry_hashes")


def run_once(spark: SparkSession, listing: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, manifest: Manifest, attempts: int = 5) -> int | None:
    """Process what the manifest doesn't hold and commit it; the batch number, or None if nothing was new.

    listing: file_path, size_bytes, entry_hashes. process gets file_path, size_bytes, entry_hashes and places (the
    zero-based entries to process) and returns what to write. What has to be processed is settled once, in a
    checkpoint: what is processed is what is committed, whatever the listing gives later. Each record is in exactly one
    committed batch. Where another run commits first, its batch is taken into account and the work done anew, up to
    attempts times; then Conflict is raised and nothing of this run is committed.
    """
    for _ in range(attempts):
        last, held = manifest.state()
        todo = checkpointed(unprocessed(listed(listing), held))
        if todo.isEmpty():
            return None
        number = last + 1
        attempt = f"{number:08d}-{uuid.uuid4().hex}"
        folder = f"{out.rstrip('/')}/{attempt}"
        process(todo.filter(F.size("places") > 0).drop("checksum")).write.parquet(folder)
        if manifest.commit(number, todo, folder, attempt):
            return number
        manifest.log.delete(folder)
    raise Conflict(f"{attempts} batches of other runs came first")


def read_committed(spark: SparkSession, manifest: Manifest, number: int | None = None) -> DataFrame:
    """What the committed batches (or one of them) wrote, with the column batch."""
    parts = [spark.read.parquet(f).withColumn("batch", F.lit(n)) for n, f in manifest.outputs() if number in (None, n)]
    if not parts:
        raise FileNotFoundError(f"no such batch is committed in {manifest.root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
