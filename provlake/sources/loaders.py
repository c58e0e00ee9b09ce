"""Readers and writers of the artifacts."""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterator
from posixpath import dirname

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions.text import cache_key as cache_name
from provlake.functions.text import evidence_kind, or_none, strip

# The columns of a claims table.
CLAIM_COLUMNS = ["claim_id", "manuscript_location", "source_file", "claim_text", "citation_key", "source_location", "quote_or_evidence", "evidence_kind", "status", "notes", "claim_type", "importance"]
REQUIRED_CLAIM_COLUMNS = ["claim_id", "citation_key", "source_location", "status"]

LOCK_ENTRY = (
    "citation_key string, short_title string, status string, "
    "record struct<title:string,authors:array<string>,year:string,venue:string,doi:string,arxiv_id:string,url:string,accessed_at:string>, "
    "authority struct<source:string,record_url:string,record_type:string,source_priority:int,bibtex_url:string>, "
    "bibtex struct<entry_type:string,citation_key:string,source_kind:string,raw_sha256:string,normalized_sha256:string,canonical_text:string,fallback_reason:string,field_checks:map<string,string>>, "
    "resolver struct<score:int,blocking_issues:array<string>,warnings:array<string>,decision_trace:array<string>>, checked_at string, checked_by string"
)
LOCK_ENTRY_STRUCT = LOCK_ENTRY.replace(" string", ":string").replace(" struct<", ":struct<")
CANDIDATE_STRUCT = "source:string,title:string,authors:array<string>,year:int,venue:string,doi:string,arxiv_id:string,url:string,is_official_record:boolean,bibtex_url:string,source_priority:int,raw:map<string,string>"
CANDIDATE = "query_id string, ord int, source string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, is_official_record boolean, bibtex_url string, source_priority int, raw map<string,string>"
QUERY_STRUCT = "query_id:string,title:string,authors:array<string>,year:int,doi:string,arxiv_id:string,citation_key:string,preferred_venues:array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, has a file; wherever Spark reads from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, body of JSON files, one value each."""
    return texts(spark, *paths).withColumnRenamed("text", "body")


# --- source texts -------------------------------------------------------------------------------------


def pdf_readable() -> bool:
    """Whether the optional PDF library is there."""
    return importlib.util.find_spec("pypdf") is not None


def pdf_issue(paths: list[str]) -> dict | None:
    """What is to be said, once, if PDFs are asked for and can't be read; up to five paths stand for all."""
    if not paths or pdf_readable():
        return None
    return {"code": "PDF_TEXT_EXTRA_MISSING", "severity": "blocking", "message": "PDF source text extraction requires the optional pypdf dependency.", "evidence": paths[:5]}


def page_texts(raw: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def pdf_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of PDFs: pages under their numbers, empty ones left out. Text is null where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    pages = page_texts(raw)
                    out.append("\n\n".join(f"[page {i}]\n{p.strip()}" for i, p in enumerate(pages, 1) if p.strip()))
                except Exception:  # a broken file, or no library: told by the null
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "path string, text string")


def source_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text of sources: PDFs through the library, all else as text."""
    pdf = [p for p in paths if p.lower().endswith(".pdf")]
    plain = [p for p in paths if not p.lower().endswith(".pdf")]
    parts = ([texts(spark, *plain)] if plain else []) + ([pdf_texts(spark, *pdf)] if pdf else [])
    if not parts:
        return spark.createDataFrame([], "path string, text string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def vision_plan(pages: DataFrame, image_dir: str | None = None) -> DataFrame:
    """page_label, needs_vision, image_path, location of PDF pages (path, page, text), for those that hold no text."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    image = F.concat(F.lit(image_dir.rstrip("/") + "/page-"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit(".png")) if image_dir else F.lit(None).cast("string")
    label = F.concat(F.lit("page "), F.col("page").cast("string"))
    return pages.select("path", "page", label.alias("page_label"), n.alias("text_char_count"), (n == 0).alias("needs_vision"), image.alias("image_path"), F.concat(F.lit("["), label, F.lit("]")).alias("expected_transcript_location"))


# --- claims, locks, candidates, queries --------------------------------------------------------------


def claims(spark: SparkSession, path: str) -> DataFrame:
    """A claims table; columns it lacks and nulls are empty, and so is a table that isn't there. See ``missing_columns``."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in CLAIM_COLUMNS))
    got = spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"')
    return got.select(*((F.coalesce(F.col(c), F.lit("")) if c in got.columns else F.lit("")).alias(c) for c in CLAIM_COLUMNS))


def missing_columns(spark: SparkSession, path: str) -> list[str]:
    there = spark.read.csv(path, sep="\t", header=True).columns
    return [c for c in REQUIRED_CLAIM_COLUMNS if c not in there]


def lock_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of lockfiles; fields that aren't known are dropped, entries without key fail, a file that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"project string, ord int, {LOCK_ENTRY}")
    got = spark.read.schema(f"schema_version string, project string, entries array<struct<{LOCK_ENTRY_STRUCT}>>").json(path, multiLine=True)
    rows = got.select("project", F.posexplode("entries").alias("ord", "e")).select("project", "ord", "e.*")
    return rows.withColumn("citation_key", F.when(F.col("citation_key").isNull(), F.raise_error(F.lit("a lock entry has no citation_key"))).otherwise(F.col("citation_key")))


def shaped(files: DataFrame, list_path: str | None = None) -> DataFrame:
    """path, ord, item (JSON): the items of files that hold a list, an object with one at ``list_path``, or one object."""
    body = strip(F.col("body"))
    within = F.get_json_object(body, f"$.{list_path}") if list_path else F.lit(None).cast("string")
    whole = F.when(F.startswith(body, F.lit("[")), body).when(within.isNotNull(), within)
    items = F.when(whole.isNotNull(), F.from_json(whole, "array<string>")).otherwise(F.array(body))
    return files.select("path", F.posexplode(items).alias("ord", "item"))


def candidate_rows(files: DataFrame) -> DataFrame:
    """Candidates of files (path, body): a list, an object with candidates, or one. What a file leaves out has its usual value."""
    c = shaped(files, "candidates").select("path", "ord", F.from_json("item", f"struct<{CANDIDATE_STRUCT}>").alias("c"))
    return c.select(
        "path", "ord", F.col("c.source").alias("c_source"), F.col("c.title").alias("c_title"), F.coalesce("c.authors", F.array().cast("array<string>")).alias("c_authors"), F.col("c.year").alias("c_year"), F.col("c.venue").alias("c_venue"),
        F.col("c.doi").alias("c_doi"), F.col("c.arxiv_id").alias("c_arxiv_id"), F.col("c.url").alias("c_url"), F.coalesce("c.is_official_record", F.lit(False)).alias("c_official"), F.col("c.bibtex_url").alias("c_bibtex_url"),
        F.coalesce("c.source_priority", F.lit(5)).alias("c_priority"), F.coalesce(F.try_element_at("c.raw", F.lit("official_record_status")) == "official_record_pending", F.lit(False)).alias("c_pending"), F.coalesce("c.raw", F.create_map().cast("map<string,string>")).alias("raw"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE).json(path, multiLine=True)


def one_candidate(files: DataFrame) -> DataFrame:
    """The one candidate of each file; a list of none or several fails."""
    rows = candidate_rows(files)
    n = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, "path").withColumn("ord", F.when(F.col("_n") == 1, F.col("ord")).otherwise(F.raise_error(F.lit("a candidate file must hold one candidate")))).drop("_n")


def query_items(files: DataFrame, default_source: str, per_query: bool = False) -> DataFrame:
    """path, ord, source, and a query's columns, of files that hold queries, one query, or work items with queries.

    The source is the default, or with per_query what the item names, then what its query names, then the first that is
    recommended. Work items without query are left out.
    """
    rows = shaped(files, "work_items")
    inner = F.get_json_object("item", "$.query")
    work = F.get_json_object("body", "$.work_items").isNotNull()
    rows = rows.join(files.select("path", work.alias("_work")), "path").where(~F.col("_work") | inner.isNotNull())
    q = F.coalesce(inner, F.col("item"))

    def named(j: Column) -> Column:
        return F.coalesce(*(or_none(F.get_json_object(j, p)) for p in ("$.live_smoke_source", "$.source", "$.recommended_sources[0]")))

    source = F.coalesce(F.nullif(named(F.col("item")), F.lit(default_source)), named(q), F.lit(default_source)) if per_query else F.lit(default_source)
    x = F.from_json(q, f"struct<{QUERY_STRUCT}>")
    no = F.array().cast("array<string>")
    rows = rows.select("path", "ord", source.alias("source"), x.alias("q")).select("path", "ord", "source", "q.*")
    return rows.withColumns({"authors": F.coalesce("authors", no), "preferred_venues": F.coalesce("preferred_venues", no)})


def queries(files: DataFrame) -> DataFrame:
    """Queries of files, of whichever of the three shapes."""
    return query_items(files, "").drop("source")


def one_query(spark: SparkSession, title: str, query_id: str | None = None, citation_key: str | None = None, authors: list[str] | None = None, year: int | None = None, doi: str | None = None, arxiv_id: str | None = None, venues: list[str] | None = None) -> DataFrame:
    """One query; names may be joined by commas, and the id falls back to the key."""
    if not title:
        raise ValueError("a query needs a title")
    names = [n.strip() for a in authors or [] for n in a.split(",") if n.strip()]
    row = (query_id or citation_key or "query", title, names, year, doi, arxiv_id, citation_key, venues or [])
    return spark.createDataFrame([row], QUERY_STRUCT.replace(":", " "))


def first_rows(rows: DataFrame, most: int | None) -> DataFrame:
    """The first rows by ord."""
    return rows if most is None else rows.orderBy("ord").limit(most)


# --- source maps and reviews --------------------------------------------------------------------------


def source_map(spark: SparkSession, path: str) -> DataFrame:
    """citation_key, source_text, source_text_raw, source_label, evidence_kind, ord of a table or a JSON list, whole or under sources.

    Relative places are taken from the map's folder; rows without key or place are left out.
    """
    names = ["citation_key", "source_text", "path", "source_label", "evidence_kind", "source_kind", "evidence_source_kind"]
    if path.lower().endswith(".json"):
        got = shaped(json_files(spark, path), "sources").select("ord", F.from_json("item", "struct<" + ",".join(f"{n}:string" for n in names) + ">").alias("x")).select("ord", "x.*")
    else:
        got = spark.read.csv(path, sep="\t", header=True).withColumn("ord", F.monotonically_increasing_id())
    return mapped(got, dirname(path))


def mapped(rows: DataFrame, base: str = "") -> DataFrame:
    """A source map's rows as they count. rows: ord and whichever of the columns there are."""
    col = lambda *names: F.coalesce(*(or_none(strip(F.col(n))) for n in names if n in rows.columns), F.lit(None).cast("string"))
    raw = col("source_text", "path")
    absolute = F.regexp_like(raw, F.lit(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"))
    place = raw if not base else F.when(absolute, raw).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw))
    label = F.coalesce(col("source_label"), F.regexp_extract(raw, r"([^/]*)$", 1))
    kind = evidence_kind(F.coalesce(col("evidence_kind", "source_kind", "evidence_source_kind"), F.lit("source_text")))
    out = rows.select(col("citation_key").alias("citation_key"), place.alias("source_text"), raw.alias("source_text_raw"), label.alias("source_label"), kind.alias("evidence_kind"), "ord")
    return out.where("citation_key is not null and source_text is not null")


REVIEW = "claim_id string, decision string, source_location string, quote_or_evidence string, evidence_kind string, review_notes string, notes string, suggested_rewrite string"
TITLE_REVIEW = "citation_key string, decision string, expected_title string, source_title string, source_candidate string, observed_title string, source_text string, reviewer string, notes string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file with one on each line, with ord, the line's place; a line that is none fails by its number."""
    rows = texts(spark, path).select(F.posexplode(F.split("text", "\n")).alias("ord", "line")).where("trim(line) <> ''")
    told = F.raise_error(F.concat(F.lit(f"{path}:"), (F.col("ord") + 1).cast("string"), F.lit(": no JSON object")))
    ok = F.try_parse_json("line").isNotNull() & F.startswith(strip(F.col("line")), F.lit("{"))
    return rows.select("ord", F.from_json(F.when(ok, F.col("line")).otherwise(told), schema).alias("x")).select("ord", "x.*")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of claims: JSON lines, a list, an object with reviews, or one."""
    if path.lower().endswith(".jsonl"):
        return json_lines(spark, path, REVIEW)
    return shaped(json_files(spark, path), "reviews").select("ord", F.from_json("item", REVIEW).alias("x")).select("ord", "x.*")


def title_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of source titles, with the observed title by whichever of its names."""
    got = json_lines(spark, path, TITLE_REVIEW)
    return got.withColumn("source_title", F.coalesce(or_none(F.col("source_title")), or_none(F.col("source_candidate")), F.col("observed_title"))).where("trim(coalesce(citation_key, '')) <> ''").drop("source_candidate", "observed_title")


ACTION_STRUCT = (
    "code:string,kind:string,citation_key:string,message:string,command:string,requires_human_review:boolean,writes_files:boolean,network_required:boolean,requires_network:boolean,missing_inputs:array<string>,"
    "input_options:array<struct<kind:string,directory:string>>,preferred_input:string,official_bibtex_url:string,selected:boolean,skip_reason:string,executed:boolean,returncode:int"
)


def next_actions(files: DataFrame) -> DataFrame:
    """Actions of manifests (path, body): next_actions, or actions where the manifest is a plan; what is no object is left out."""
    some = lambda p: F.when(F.startswith(F.get_json_object("body", p), F.lit("[")), F.get_json_object("body", p))
    own = F.when(some("$.next_actions") != "[]", some("$.next_actions"))
    plan = F.get_json_object("body", "$.schema_version").contains("next_actions")
    rows = files.select(F.col("path").alias("manifest"), F.posexplode(F.from_json(F.coalesce(own, F.when(plan, some("$.actions"))), "array<string>")).alias("ord", "item"))
    rows = rows.where(F.startswith("item", F.lit("{")))
    # commands by their names, beside the plain one
    keys = F.json_object_keys("item")
    more = F.map_from_entries(F.transform(F.filter(keys, lambda k: F.endswith(k, F.lit("_command"))), lambda k: F.struct(k, F.lit(""))))
    every = F.from_json("item", "map<string,string>")
    commands = F.transform_values(more, lambda k, _: F.coalesce(F.try_element_at(every, k), F.lit("")))
    return rows.select("manifest", "ord", F.from_json("item", f"struct<{ACTION_STRUCT}>").alias("x"), commands.alias("more_commands")).select("manifest", "ord", "x.*", "more_commands")


# --- cache --------------------------------------------------------------------------------------------


def append_cache(records: DataFrame, path: str) -> None:
    """Cached responses, one folder for each source."""
    records.write.partitionBy("source").parquet(path, mode="append")


def cache_record(source: Column, url: Column, body: Column, fetched_at: Column) -> list[Column]:
    """A response's columns: source, url, status, body, body_sha256, fetched_at, file."""
    return [source.alias("source"), url.alias("url"), F.lit(200).alias("status"), body.alias("body"), F.sha2(body, 256).alias("body_sha256"), fetched_at.alias("fetched_at"), F.concat(source, F.lit("/"), cache_name(url)).alias("file")]


def cache_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source, url, sha of cached responses; bodies aren't read."""
    return spark.read.parquet(path).select("source", "url", F.col("body_sha256").alias("sha"))


def cache_files(spark: SparkSession, root: str, files: str = "*/*.json") -> DataFrame:
    """source, url, body_sha256, path of responses kept as JSON files, one each, in folders by source (or as ``files`` says); none if there is no folder."""
    kind = "source string, url string, body_sha256 string"
    if not exists(spark, f"{root}/{files}"):
        return spark.createDataFrame([], kind + ", path string")
    return spark.read.schema(kind).json(f"{root}/{files}", multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))


def cached(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The responses to wanted (source, url), those that there are; of several the latest."""
    last = cache.join(wanted.select("source", "url").distinct(), ["source", "url"], "left_semi")
    cols = [c for c in cache.columns if c not in ("source", "url")]
    return last.groupBy("source", "url").agg(F.max_by(F.struct(*cols), "fetched_at").alias("x")).select("source", "url", "x.*")


# --- writers ------------------------------------------------------------------------------------------


def write_claims(table: DataFrame, path: str) -> None:
    """A claims table in its twelve columns; others are left out."""
    table.select(*CLAIM_COLUMNS).write.csv(path, sep="\t", header=True, mode="overwrite")


def write_json(rows: DataFrame, path: str) -> None:
    """Work items, bundles, plans: an object a line."""
    rows.write.json(path, mode="overwrite")


def sensitive_config(path: str) -> dict[str, str]:
    """Keys of a private file; they stay on the driver and never come into a table."""
    try:
        with open(path, encoding="utf-8") as f:
            return {str(k): str(v) for k, v in json.load(f).items() if v}
    except FileNotFoundError:
        return {}


def auth_value(name: str, config: dict[str, str]) -> tuple[str | None, str | None]:
    """A key's value and where it is from: the environment, or else the private file."""
    variable = "PROVLAKE_" + name.upper().replace("-", "_")
    if os.environ.get(variable):
        return os.environ[variable], "environment"
    return (config[name], "config") if config.get(name) else (None, None)


def masked(value: str | None) -> str:
    """A key as it may be shown."""
    return "" if not value else "*" * len(value) if len(value) < 8 else f"{value[:2]}...{value[-2:]}"


def auth_status(names: list[str], config: dict[str, str]) -> list[dict[str, str | None]]:
    """What is known of keys, without their values: name, origin, masked, and a warning for one that is missing."""
    out = []
    for name in names:
        value, origin = auth_value(name, config)
        out.append({"name": name, "origin": origin, "masked": masked(value), "issue": None if value else "AUTH_VALUE_MISSING"})
    return out
