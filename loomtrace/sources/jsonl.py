"""Session logs as JSONL: discovery, lines, headers and validated entries.

A file is good as a whole or not at all: its first record is the header, all others are entries, and one invalid
record makes an error of the file. Lines are parsed to VARIANT inside the JVM.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.positions import dense_position

EXTENSIONS = (".jsonl",)
HEADER_BYTES = 64 * 1024
#: The largest file that is read as one value; Spark holds no value of 2 GiB.
WHOLE_BYTES = 1 << 30
_BLANK = r"^(?U)[\s\x{FEFF}]*$"


def default_session_dir() -> str:
    """LOOMTRACE_SESSION_DIR, else ~/.loomtrace/sessions."""
    return os.environ.get("LOOMTRACE_SESSION_DIR") or str(Path.home() / ".loomtrace" / "sessions")


def discover(roots: Iterable[str] | None = None, extensions: Iterable[str] = EXTENSIONS) -> list[str]:
    """The session files below the roots, sorted, each once. Links are neither files nor folders; roots that aren't
    there, that are no folders, or that can't be read are passed over."""
    wanted = {x.lower() for x in extensions}
    found: set[str] = set()
    stack = [r for r in (roots or [default_session_dir()]) if os.path.isdir(r)]
    while stack:
        try:
            entries = list(os.scandir(stack.pop()))
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                stack.append(e.path)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in wanted:
                found.add(e.path)
    return sorted(found, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def _glob(extensions: Iterable[str]) -> str:
    return "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions) + "}"


def listing(spark: SparkSession, roots: Iterable[str], extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """file_path, size_bytes, mtime_ms of the files below the roots, listed by Spark."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).load(list(roots))
    return df.select(_path(F.col("path")).alias("file_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))


def _path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def _metadata_path() -> Column:
    """The path of a row's file as listings write it; metadata escape it."""
    return _path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))


def read_lines(spark: SparkSession, roots: Iterable[str], extensions: Iterable[str] = EXTENSIONS, whole: int = WHOLE_BYTES) -> DataFrame:
    """file_path, line_no (from 1), raw_text of every line below the roots. A file of up to whole bytes is read whole to
    keep its order; the splits of a larger one are numbered each and then put one after the other."""
    roots = list(roots)
    df = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=_glob(extensions))
    large = [r.file_path for r in listing(spark, roots, extensions).filter(F.col("size_bytes") > whole).select("file_path").toLocalIterator()]
    if large:  # files of a gigabyte and more are few
        kept = listing(spark, roots, extensions).filter(F.col("size_bytes") <= whole).select("file_path").collect()
        df = spark.read.text([r.file_path for r in kept], wholetext=True) if kept else df.filter("false")
    out = _numbered(df)
    return out.unionByName(split_lines(spark, large)) if large else out


def lines_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of some files, columns as in read_lines."""
    if not files:
        return spark.createDataFrame([], "file_path string, line_no int, raw_text string")
    return _numbered(spark.read.text(files, wholetext=True))


def _numbered(df: DataFrame) -> DataFrame:
    df = df.select(_metadata_path().alias("file_path"), F.posexplode(F.split("value", "\r?\n")).alias("i", "raw_text"))
    return df.select("file_path", (F.col("i") + 1).alias("line_no"), "raw_text")


def split_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of files of any size, columns as in read_lines."""
    df = spark.read.text(files, lineSep="\n").select(_metadata_path().alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("raw_text"))
    within = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("row"))
    sizes = df.groupBy("file_path", "block").agg(F.count("*").alias("n"))  # one row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).drop("n")
    return df.withColumn("i", within).join(sizes, ["file_path", "block"]).select("file_path", (F.col("before") + F.col("i")).cast("int").alias("line_no"), "raw_text")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first HEADER_BYTES of each file, without reading more."""
    from pyarrow import fs

    for b in batches:
        out = []
        for path in b.column("file_path").to_pylist():
            try:
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as f:
                    out.append(f.read(HEADER_BYTES).decode("utf-8", "replace"))
            except OSError:
                out.append(None)
        yield b.append_column("head", pa.array(out, pa.string()))


def read_headers(spark: SparkSession, roots: Iterable[str], extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """Header columns and error of each file, out of its first 64 KiB; nothing more of it is read. A file that goes
    away or can't be opened has the error unreadable."""
    files = listing(spark, roots, extensions)
    df = files.mapInArrow(_heads, "file_path string, size_bytes long, mtime_ms long, head string")
    line = F.get(F.filter(F.split("head", "\r?\n"), lambda x: ~x.rlike(_BLANK)), F.lit(0))
    df = df.withColumn("raw_text", line)
    v = F.try_parse_json("raw_text")
    error = F.when(F.col("head").isNull(), "unreadable").when(F.col("raw_text").isNull(), "no header").otherwise(_record_error(F.col("raw_text"), F.col("v")))
    h = df.withColumn("v", v)
    return h.select("file_path", "size_bytes", "mtime_ms", *header_columns(F.col("v")), F.coalesce(error, header_error(F.col("v"))).alias("error"))


def string_at(v: Column, name: str) -> Column:
    """A string field of a VARIANT record; null if it is missing or of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def type_at(v: Column, name: str) -> Column:
    """The type name of a field: STRING, VOID, BIGINT, ...; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def _filled(v: Column, *names: str) -> Column:
    return F.coalesce(*[F.when(string_at(v, n) != "", string_at(v, n)) for n in names])


def header_columns(v: Column) -> list[Column]:
    """session_id, created_at, cwd, parent_session in either vocabulary; empty strings count as missing."""
    return [_filled(v, "sessionId", "id").alias("session_id"), _filled(v, "createdAt", "timestamp").alias("created_at"), _filled(v, "cwd").alias("cwd"), _filled(v, "parentSession").alias("parent_session")]


def header_error(v: Column) -> Column:
    """What a header lacks, null if nothing."""
    return F.when(_filled(v, "sessionId", "id").isNull(), "header without session id").when(_filled(v, "createdAt", "timestamp").isNull(), "header without creation time").when(_filled(v, "cwd").isNull(), "header without cwd")


def entry_error(v: Column) -> Column:
    """What is wrong with an entry, null if nothing. Types aren't coerced."""
    parent = type_at(v, "parentId")
    return (
        F.when(_filled(v, "id").isNull(), "entry without id")
        .when(string_at(v, "timestamp").isNull(), "entry without timestamp")
        .when(_filled(v, "type").isNull(), "entry without type")
        .when(parent.isNotNull() & ~parent.isin("STRING", "VOID"), "entry with a parent that is no string")
    )


def _record_error(raw: Column, v: Column) -> Column:
    return F.when(v.isNull(), "invalid JSON").when(~F.ltrim(raw).startswith("{"), "no JSON object")


@dataclass
class Parsed:
    """headers: file_path, session_id, created_at, cwd, parent_session. entries: file_path, session_id, line_no,
    append_seq, entry_id, parent_id, entry_ts, entry_type, raw_text, v, hash. errors: file_path, line_no, error."""

    headers: DataFrame
    entries: DataFrame
    errors: DataFrame


def entry_hash(raw: Column) -> Column:
    """Eight hex digits that stand for a line's content."""
    return F.substring(F.sha2(raw, 256), 1, 8)


def parse(lines: DataFrame) -> Parsed:
    """Validate the lines (file_path, line_no, raw_text) of session files.

    Blank lines are skipped but counted. The first error of a file is reported; a repeated entry id is one, at its
    second place, if nothing else is wrong. Exact repetitions of a row count once; rows without path or text are left
    out. A file of blank lines has no header.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    rows = lines.filter("file_path IS NOT NULL AND raw_text IS NOT NULL").select("file_path", "line_no", "raw_text").distinct()
    rows = rows.withColumn("blank", F.col("raw_text").rlike(_BLANK))
    first = rows.groupBy("file_path").agg(F.min(F.when(~F.col("blank"), F.col("line_no"))).alias("first"), F.min("line_no").alias("low"))
    empty = first.filter("first IS NULL").select("file_path", F.col("low").alias("line_no"), F.lit("no header").alias("error"))
    rows = salted_join(rows.filter("NOT blank"), first.filter("first IS NOT NULL").select("file_path", "first"), ["file_path"], ["line_no"])
    rows = rows.withColumn("v", F.try_parse_json("raw_text"))
    is_header = F.col("line_no") == F.col("first")
    v = F.col("v")
    rows = rows.withColumn("error", F.coalesce(_record_error(F.col("raw_text"), v), F.when(is_header, header_error(v)).otherwise(entry_error(v))))
    entry = rows.filter(~is_header)
    ids = entry.filter("error IS NULL").select("file_path", "line_no", string_at(v, "id").alias("entry_id"))
    second = ids.withColumn("rn", F.expr("row_number() OVER (PARTITION BY file_path, entry_id ORDER BY line_no)")).filter("rn = 2")
    top = F.min(F.struct("line_no", "error")).alias("x")
    wrong = rows.filter("error IS NOT NULL").groupBy("file_path").agg(top).select("file_path", "x.*")
    again = second.groupBy("file_path").agg(F.min("line_no").alias("line_no")).select("file_path", "line_no", F.lit("repeated entry id").alias("error"))
    errors = wrong.unionByName(again.join(wrong, "file_path", "left_anti")).unionByName(empty)
    good = rows.join(errors.select("file_path"), "file_path", "left_anti")
    headers = good.filter(is_header).select("file_path", *header_columns(v))
    e = good.filter(~is_header).select(
        "file_path", "line_no", string_at(v, "id").alias("entry_id"), string_at(v, "parentId").alias("parent_id"), string_at(v, "timestamp").alias("entry_ts"),
        string_at(v, "type").alias("entry_type"), "raw_text", "v", entry_hash(F.col("raw_text")).alias("hash"),
    )
    e = dense_position(e, "file_path", "line_no", "entry_id", "append_seq")
    e = salted_join(e, headers.select("file_path", "session_id"), ["file_path"], ["line_no"])
    return Parsed(headers, e, errors)


def source_info(parsed: Parsed) -> DataFrame:
    """file_path, session_id, entry_count, first_entry_id, last_entry_id, entry_hashes, header_hash of good files."""
    h = parsed.headers.select("file_path", "session_id", F.substring(F.sha2(F.to_json(F.struct("session_id", "created_at", "cwd", "parent_session"), {"ignoreNullFields": "false"}), 256), 1, 8).alias("header_hash"))
    e = parsed.entries.groupBy("file_path").agg(
        F.count("*").alias("entry_count"), F.min_by("entry_id", "append_seq").alias("first_entry_id"), F.max_by("entry_id", "append_seq").alias("last_entry_id"),
        F.transform(F.sort_array(F.collect_list(F.struct("append_seq", "hash"))), lambda x: x["hash"]).alias("entry_hashes"),
    )
    out = h.join(e, "file_path", "left")
    return out.select("file_path", "session_id", F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "first_entry_id", "last_entry_id", F.coalesce("entry_hashes", F.array().cast("array<string>")).alias("entry_hashes"), "header_hash")


def from_memory(spark: SparkSession, header: dict, entries: list[dict]) -> DataFrame:
    """Lines of a session that a host holds in memory; its hashes are placeholders and prove nothing."""
    rows = [("<memory>", i + 1, json.dumps(x, ensure_ascii=False)) for i, x in enumerate([header, *entries])]
    return spark.createDataFrame(rows, "file_path string, line_no int, raw_text string")
