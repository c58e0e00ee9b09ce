"""Files written by executors: downloads, synced bibliographies, lockfiles and cached responses, one file a row.

A Python data source writes each payload under an attempt-unique name into a staging folder beside the target, and each
task that ends well leaves one manifest of what it staged. ``commit`` names the manifests that count in one small file, put
in place by a rename; ``abort`` removes the staging folder. So an attempt that fails, or is run twice, leaves nothing that
anyone reads. Publishing is a second job: manifests are read as a table, names are checked, and tasks move staged files to
their places. A move that was made before is seen by its missing source, so lost tasks may repeat, and a driver that died
between the two jobs is made up for by ``publish``. No payload passes the driver; it sees a name a task.

Edge cases: a row with a null payload writes no file and keeps its note as status. An empty payload is an empty file. A
null name, an empty one, one that starts with a slash, or one with a part that is empty, ``.`` or ``..`` fails the job before anything is
staged for it, and names that two rows share fail it before anything is moved. An empty table publishes nothing. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from provlake.functions.text import cache_key
from provlake.session import checkpointed, dealt

STAGING = "_staging"
MANIFEST = "name string, staged string, bytes long, sha256 string, note string"
OUTCOME = "name string, status string, bytes long, sha256 string"
MANIFEST_ROWS = 10_000
#: Files that a task moves, and the greatest number of tasks.
MOVES, MOST_TASKS = 500, 10_000
#: Bytes of files that are handed on at once.
READ_BYTES = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def checked(name: str | None) -> str:
    if not name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"no file's name: {name!r}")
    return name


class Staged(WriterCommitMessage):
    """What a finished task tells: its manifests."""

    def __init__(self, manifests: list[str]):
        self.manifests = manifests


class StagingWriter(DataSourceArrowWriter):
    """Stages rows (name, payload, note); see the module."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, at = filesystem(self.folder)
        attempt = uuid.uuid4().hex
        where.create_dir(f"{at}/{attempt}", recursive=True)
        where.create_dir(f"{at}/manifests", recursive=True)
        told, lines, n = [], [], 0

        def tell() -> None:
            name = f"{attempt}-{len(told)}.json"
            with where.open_output_stream(f"{at}/manifests/{name}") as out:
                out.write("".join(lines).encode())
            told.append(name)
            lines.clear()

        for b in iterator:
            for row in zip(*(b.column(c) for c in ("name", "payload", "note")), strict=True):
                name, payload, note = (x.as_py() for x in row)
                checked(name)
                line = {"name": name, "note": note}
                if payload is not None:
                    line |= {"staged": f"{attempt}/{n}", "bytes": len(payload), "sha256": hashlib.sha256(payload).hexdigest()}
                    with where.open_output_stream(f"{at}/{attempt}/{n}") as out:
                        out.write(payload)
                    n += 1
                lines.append(json.dumps(line) + "\n")
                if len(lines) == MANIFEST_ROWS:
                    tell()
        if lines:
            tell()
        return Staged(told)

    def commit(self, messages: list[Staged | None]) -> None:
        where, at = filesystem(self.folder)
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/committing") as out:
            out.write("".join(f"{name}\n" for m in messages if m for name in m.manifests).encode())
        where.move(f"{at}/committing", f"{at}/committed")

    def abort(self, messages: list[Staged | None]) -> None:
        removed(self.folder)


class StagingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provlake_files"

    def schema(self) -> str:
        return "name string, payload binary, note string"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["path"])


def removed(folder: str) -> None:
    where, at = filesystem(folder)
    if where.get_file_info(at).type != pafs.FileType.NotFound:
        where.delete_dir(at)


def pending(folder: str) -> list[str]:
    """Jobs that were committed but not published to the end."""
    where, at = filesystem(folder)
    jobs = where.get_file_info(pafs.FileSelector(f"{at}/{STAGING}", allow_not_found=True))
    return sorted(j.base_name for j in jobs if where.get_file_info(f"{j.path}/committed").type == pafs.FileType.File)


def stage(files: DataFrame, folder: str) -> str:
    """Stage files (name, payload, and note if there is one) beside a folder; the job to publish."""
    job = uuid.uuid4().hex
    spark = files.sparkSession
    spark.dataSource.register(StagingSource)
    note = F.col("note").cast("string") if "note" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("payload").cast("binary").alias("payload"), note.alias("note"))
    rows.write.format("provlake_files").mode("append").save(f"{folder}/{STAGING}/{job}")
    return job


def manifests(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """What the finished tasks of a job staged; what others left behind isn't named by its commit."""
    at = f"{folder}/{STAGING}/{job}"
    counted = spark.read.text(f"{at}/committed").select(F.col("value").alias("_file"))
    where, path = filesystem(f"{at}/manifests")
    if where.get_file_info(path).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], MANIFEST)
    told = spark.read.schema(MANIFEST).json(f"{at}/manifests").withColumn("_file", F.col("_metadata.file_name"))
    return told.join(counted, "_file", "left_semi").drop("_file")


def publish(spark: SparkSession, folder: str, job: str, overwrite: bool = False) -> DataFrame:
    """Move a job's files into place: name, status (written, skipped_exists, or the row's note), bytes, sha256.

    May be run again after a failure. Without ``overwrite`` a file that is there stays as it is.
    """
    rows = manifests(spark, folder, job)
    twice = rows.groupBy("name").count().where("count > 1").limit(5).collect()
    if twice:
        removed(f"{folder}/{STAGING}/{job}")
        raise ValueError(f"names that several rows share: {sorted(r['name'] for r in twice)}")
    source = f"{folder}/{STAGING}/{job}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = filesystem(folder)
        _, held = filesystem(source)
        made: set[str] = set()
        for b in batches:
            status = []
            for name, staged, note in zip(*(b.column(c).to_pylist() for c in ("name", "staged", "note")), strict=True):
                if staged is None:
                    status.append(note)
                    continue
                target = f"{at}/{name}"
                ours, there = (i.type != pafs.FileType.NotFound for i in where.get_file_info([f"{held}/{staged}", target]))
                if not ours and not there:
                    raise FileNotFoundError(f"{name} is neither staged nor published")
                if ours and there and not overwrite:
                    status.append("skipped_exists")
                    continue
                if ours:
                    parent = target.rsplit("/", 1)[0]
                    if parent not in made:
                        where.create_dir(parent, recursive=True)
                        made.add(parent)
                    moved(where, f"{held}/{staged}", target)
                status.append("written")
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(status, pa.string()), b.column("bytes"), b.column("sha256")], names=["name", "status", "bytes", "sha256"])

    # a number of its own, as moves cost by files, and rows without payloads are too small to be dealt out by bytes
    tasks = min(-(-rows.count() // MOVES) or 1, MOST_TASKS)
    done = checkpointed(rows.repartition(tasks, "name").mapInArrow(run, OUTCOME))
    removed(source)
    return done


def moved(where: pafs.FileSystem, source: str, target: str) -> None:
    """A move that replaces; where a file system's doesn't, the old file goes first."""
    try:
        where.move(source, target)
    except OSError:
        if where.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        where.delete_file(target)
        where.move(source, target)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Files (name, payload, note) written by executors, all or none of a job staged; see ``publish`` for what comes back."""
    return publish(files.sparkSession, folder, stage(files, folder), overwrite)


def read_back(done: DataFrame, folder: str) -> DataFrame:
    """name, content of the files of an outcome that are there, read by the tasks that hold their names.

    Nothing is listed, and as many small files share a task as a task had moved; a reader of a folder has its files listed
    by the driver and deals out a few dozen a task. A file that is gone fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = filesystem(folder)
        for b in batches:
            names: list[str] = []
            held: list[bytes] = []
            size = 0
            for name in b.column(0).to_pylist():
                with where.open_input_stream(f"{at}/{name}") as file:
                    held.append(file.read())
                names.append(name)
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["name", "content"])
                    names, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["name", "content"])

    return done.where(F.col("status").isin("written", "skipped_exists")).select("name").mapInArrow(run, "name string, content binary")


# --- what is written ----------------------------------------------------------------------------------


def downloads(done: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files of a fetch stage's downloads (citation_key, status, payload), by the plan's outputs (citation_key, output)."""
    return done.join(outputs.select("citation_key", F.col("output").alias("name")), "citation_key").select("name", "payload", F.col("status").alias("note"))


def synced(texts: DataFrame) -> DataFrame:
    """Files of synced bibliographies (path, text, ok): none of one with a blocked entry."""
    return texts.select(F.col("path").alias("name"), F.when(F.col("ok"), F.encode("text", "UTF-8")).alias("payload"), F.when(~F.col("ok"), "blocked").alias("note"))


def indented(rows: DataFrame, column: str) -> DataFrame:
    """Rows (name, and an object as JSON) as files of sorted keys with an indent of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [json.dumps(json.loads(x), ensure_ascii=False, indent=2, sort_keys=True).encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["name", "payload"])

    return rows.select("name", column).mapInArrow(run, "name string, payload binary")


def lockfiles(lock: DataFrame, name: Column, generated_at: str | None = None) -> DataFrame:
    """Files of lockfiles, one a project, entries by key. lock: project and an entry's columns; name: of project."""
    entry = F.to_json(F.struct(*[c for c in lock.columns if c not in ("project", "ord")]), {"ignoreNullFields": "false"})
    # one project's lock, as one file holds it; dealt out, as the work goes by files and partitions are merged by bytes
    whole = dealt(lock, "project").groupBy("project").agg(F.array_sort(F.collect_list(F.struct("citation_key", entry.alias("e")))).alias("x"))
    said = lambda c: F.regexp_replace(F.to_json(F.array(c.cast("string")), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    body = F.concat(
        F.lit('{"schema_version":"lock.v1","audit_policy":{},"generated_at":'), said(F.lit(generated_at)), F.lit(',"project":'), said(F.col("project")),
        F.lit(',"entries":['), F.array_join(F.transform("x", lambda e: e["e"]), ","), F.lit("]}"),
    )
    return indented(whole.select(name.alias("name"), body.alias("body")), "body")


def responses(records: DataFrame) -> DataFrame:
    """Files of cached responses (source, url, status, body, fetched_at), a folder a source; of one address the latest.

    With a column ``cache`` a response is one of that cache, a folder above the sources' folders. Of responses fetched at
    one time that with the greatest status and body counts, so that a run that is repeated writes the same.
    """
    at = ["cache"] if "cache" in records.columns else []
    latest = F.struct(F.col("fetched_at").isNotNull().alias("_has"), "fetched_at", "status", "body")
    last = records.groupBy(*at, "source", "url").agg(F.max_by(F.struct("status", "body", "fetched_at"), latest).alias("r")).select(*at, "source", "url", "r.*")
    body = F.struct("source", "url", "status", F.create_map().cast("map<string,string>").alias("headers"), "body", "fetched_at", F.sha2("body", 256).alias("body_sha256"))
    return indented(last.select(F.concat_ws("/", *at, "source", cache_key(F.col("url"))).alias("name"), F.to_json(body, {"ignoreNullFields": "false"}).alias("record")), "record")
