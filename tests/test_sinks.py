"""Files written by executors: whole results, failures that leave nothing, repeats."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from provlake.operators import actions
from provlake.sources import fetch, loaders, sinks

FILES = "name string, payload binary, note string, bytes string"


def listed(folder) -> dict[str, bytes]:
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_and_notes(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.txt", f"text {i} é".encode(), None, "clash") for i in range(50)] + [("empty", b"", "x", None), ("none", None, "missing_url", None)]
    got = {r["name"]: r for r in sinks.write_files(spark.createDataFrame(rows, FILES).repartition(7), str(tmp_path)).collect()}
    assert listed(tmp_path) == {n: p for n, p, *_ in rows if p is not None}
    assert len(got) == 52 and got["none"]["status"] == "missing_url" and got["none"]["bytes"] is None
    assert all(got[n]["status"] == "written" and got[n]["bytes"] == len(p) and got[n]["sha256"] == hashlib.sha256(p).hexdigest() for n, p, *_ in rows if p is not None)
    assert not sinks.pending(str(tmp_path))


def test_what_is_there_stays_unless_told(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"old")
    new = spark.createDataFrame([("a", b"new", None, None), ("b", b"b", None, None)], FILES)
    assert {r["name"]: r["status"] for r in sinks.write_files(new, str(tmp_path)).collect()} == {"a": "skipped_exists", "b": "written"}
    assert listed(tmp_path) == {"a": b"old", "b": b"b"}
    assert {r["status"] for r in sinks.write_files(new, str(tmp_path), overwrite=True).collect()} == {"written"}
    assert listed(tmp_path) == {"a": b"new", "b": b"b"}


@pytest.mark.parametrize("name", [None, "", "/etc/x", "../x", "a//b", "a/./b"])
def test_bad_names_leave_nothing(spark, tmp_path, name):
    rows = spark.createDataFrame([("good", b"x", None, None), (name, b"y", None, None)], FILES)
    with pytest.raises(Exception, match="no file's name"):
        sinks.write_files(rows, str(tmp_path / "t"))
    assert listed(tmp_path) == {}


def test_shared_names_leave_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"x", None, None), ("a", b"x", None, None), ("b", b"y", None, None)], FILES)
    with pytest.raises(ValueError, match="share"):
        sinks.write_files(rows, str(tmp_path))
    assert listed(tmp_path) == {}


def test_empty_table(spark, tmp_path):
    assert sinks.write_files(spark.createDataFrame([], FILES), str(tmp_path)).count() == 0
    assert listed(tmp_path) == {}


def test_publishing_again_after_a_lost_driver(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", b"%d" % i, None, None) for i in range(9)], FILES).repartition(3)
    job = sinks.stage(rows, str(tmp_path))
    assert sinks.pending(str(tmp_path)) == [job]
    first = sinks.manifests(spark, str(tmp_path), job).where("name < 'f4'").collect()
    for r in first:
        os.replace(tmp_path / sinks.STAGING / job / r["staged"], tmp_path / r["name"])
    stray = tmp_path / sinks.STAGING / job / "manifests" / "stray.json"
    stray.write_text('{"name": "stray", "staged": "nowhere/0"}\n')
    assert {r["status"] for r in sinks.publish(spark, str(tmp_path), job).collect()} == {"written"}
    assert listed(tmp_path) == {f"f{i}": b"%d" % i for i in range(9)}


RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from provlake.sources import sinks
folder, mark = sys.argv[1:]
spark = SparkSession.builder.master("local[2, 3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()
def once(batches):
    import pyarrow as pa
    for b in batches:
        yield b.slice(0, b.num_rows // 2)
        try:
            os.close(os.open(mark, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            yield b.slice(b.num_rows // 2)
        else:
            raise RuntimeError("lost")
rows = spark.range(40, numPartitions=2).selectExpr("concat('f', id) name", "cast(cast(id as string) as binary) payload", "cast(null as string) note")
got = sinks.write_files(rows.mapInArrow(once, rows.schema), folder)
assert got.count() == 40 and got.where("status = 'written'").count() == 40
"""


def test_a_task_that_fails_once_leaves_no_stray_file(tmp_path):
    run = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "t"), str(tmp_path / "mark")], capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert (tmp_path / "mark").exists()
    assert listed(tmp_path / "t") == {f"f{i}": b"%d" % i for i in range(40)}


def test_synced_bibliographies(spark, tmp_path):
    texts = spark.createDataFrame([("a.bib", "@misc{a}\n", True, 1), ("b.bib", "@misc{b}\n", False, 1)], "path string, text string, ok boolean, changes int")
    got = {r["name"]: r["status"] for r in sinks.write_files(sinks.synced(texts), str(tmp_path)).collect()}
    assert got == {"a.bib": "written", "b.bib": "blocked"} and listed(tmp_path) == {"a.bib": b"@misc{a}\n"}


def test_downloads_are_fetched_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fetcher(url):
        if url == "bad":
            raise OSError("gone")
        (calls / os.urandom(8).hex()).write_text(url)
        return url.encode()

    items = spark.createDataFrame([("a", "u-a", "a.pdf"), ("b", "bad", "b.pdf"), ("c", None, "c.pdf"), ("d", "u-d", "d.pdf")], "citation_key string, url string, output string")
    done = fetch.download(items, fetcher, spark.createDataFrame([("d.pdf",)], "path string"))
    got = {r["name"]: r["status"] for r in sinks.write_files(sinks.downloads(done, items), str(tmp_path / "out")).collect()}
    assert got == {"a.pdf": "written", "b.pdf": "download_failed", "c.pdf": "missing_url", "d.pdf": "skipped_exists"}
    assert listed(tmp_path / "out") == {"a.pdf": b"u-a"} and sorted(p.read_text() for p in calls.iterdir()) == ["u-a"]


def test_lockfiles_and_responses_read_back(spark, tmp_path):
    lock = spark.createDataFrame([("p", 0, "b", "é \" x", None), ("p", 1, "a", "verified", ["n"]), ("q\"", 0, "c", None, [])], "project string, ord int, citation_key string, status string, notes array<string>")
    sinks.write_files(sinks.lockfiles(lock, F.concat(F.sha2("project", 256), F.lit(".json")), "2024"), str(tmp_path / "locks"))
    bodies = {json.loads(b)["project"]: b for b in listed(tmp_path / "locks").values()}
    want = {"audit_policy": {}, "entries": [{"citation_key": "a", "notes": ["n"], "status": "verified"}, {"citation_key": "b", "notes": None, "status": "é \" x"}], "generated_at": "2024", "project": "p", "schema_version": "lock.v1"}
    assert bodies["p"].decode() == json.dumps(want, ensure_ascii=False, indent=2, sort_keys=True) and set(bodies) == {"p", 'q"'}
    records = spark.createDataFrame([("acl", "https://x.org/a?b", 200, "old", "2023"), ("acl", "https://x.org/a?b", 200, "new é", "2024"), ("iclr", "u", 200, "z", None)], "source string, url string, status int, body string, fetched_at string")
    sinks.write_files(sinks.responses(records), str(tmp_path / "cache"))
    got = {(r["source"], r["url"]): r["body_sha256"] for r in loaders.cache_files(spark, str(tmp_path / "cache")).collect()}
    assert got == {("acl", "https://x.org/a?b"): hashlib.sha256("new é".encode()).hexdigest(), ("iclr", "u"): hashlib.sha256(b"z").hexdigest()}


def test_what_a_synchronization_sets_off(spark):
    kind = "path string, ord long, citation_key string, action string, reason string, source_kind string"
    lacking = "canonical_bibtex_text_missing"
    rows = [("a b.bib", 0, "k", "replace", "current_bibtex_differs_from_lock_canonical", "official_export"), ("same.bib", 0, "k", "unchanged", "already_synced", "official_export")]
    rows += [("c.bib", 2, "z", "blocked", lacking, "official_export"), ("c.bib", 1, "y y", "blocked", lacking, "official_export"), ("c.bib", 0, "m", "blocked", lacking, None), ("c.bib", 3, "n", "add", "missing_from_bib", "official_export")]
    table = spark.createDataFrame(rows, kind)
    got = [(r["path"], r["code"], r["command"]) for r in actions.sync_actions(table, "l.json", asked=["k"]).orderBy("path", "ord").collect()]
    assert got == [
        ("a b.bib", "WRITE_SYNCED_BIBTEX", "python -m provlake sync-bibtex --bib 'a b.bib' --lock l.json --output references.provlake.bib --json --citation-key k"),
        ("c.bib", "REFRESH_LOCK_CANONICAL_BIBTEX", "python -m provlake reference-check --lock l.json --write-lock l.json --fetch-official-bibtex --live --json --citation-key 'y y' --citation-key z"),
        ("c.bib", "BACKFILL_MANUAL_CANONICAL_BIBTEX", "python -m provlake reference-check --lock l.json --bibtex-dir REVIEWED_FALLBACK_BIBTEX_DIR --write-lock l.json --json --citation-key m"),
    ]
    assert {r["path"] for r in actions.sync_actions(table, "l.json", wrote=True).collect()} == {"c.bib"}
    assert actions.sync_actions(table.limit(0), "l.json").count() == 0


def test_what_a_download_plan_sets_off(spark):
    items = spark.createDataFrame([("a", "u"), ("a", None), ("b", None), ("c", "")], "lock string, url string")
    got = [(r["lock"], r["command"]) for r in actions.download_actions(items, "s", ["k"]).collect()]
    assert got == [("a", "python -m provlake download-sources --lock a --source-dir s --citation-key k --live --json")]
    assert actions.download_actions(items, "s", live=True).count() == 0


def test_files_are_read_back_by_the_names_that_were_written(spark, tmp_path):
    files = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") != 7, F.encode(F.concat(F.lit("x"), F.col("id").cast("string")), "UTF-8")).alias("payload"), F.lit("none").alias("note"))
    done = sinks.write_files(files, str(tmp_path / "t"))
    there = sinks.read_back(done, str(tmp_path / "t"))
    assert {(r["name"], bytes(r["content"])) for r in there.collect()} == {(f"d/{i}", f"x{i}".encode()) for i in range(40) if i != 7}
    # no folder is listed, so the number of tasks goes by names and not by files
    assert there.rdd.getNumPartitions() == done.rdd.getNumPartitions()


def test_locks_are_dealt_out(spark):
    """Small locks aren't merged into one task: what a task does goes by its files."""
    lock = spark.range(64).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project"), F.lit("k").alias("citation_key"))
    files = sinks.lockfiles(lock, F.concat("project", F.lit(".json")))
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 1
