"""Files found by citation key or by title, and the reference check that is put together from what they hold."""

from __future__ import annotations

from posixpath import dirname, normpath, relpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions.text import normalize_title, present
from provlake.operators import locks, resolve
from provlake.sources import records

#: Names that a key's file may have, best first.
CANDIDATE_FILES = ["{key}.json", "{key}.candidates.json"]
BIBTEX_FILES = ["{key}.bib", "{key}.bibtex"]
EXPORT_FILES = [n + s for s in (".bib", ".bibtex") for n in ("{key}.{source}", "{key}.source", "{key}")]
PAGE_FILES = ["{key}.{source}.html", "{key}.html"]


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, stem, suffix of a folder's files; what they hold isn't read."""
    return named(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path"))


def named(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return files.withColumns({"name": name, "suffix": suffix, "stem": F.when(suffix != "", F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)})


def by_key(entries: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """entries (citation_key, and source) with path and name of their file, by the first of the names that there is."""
    by = [c for c in ("citation_key", "source") if c in entries.columns]

    def filled(pattern: str) -> Column:
        out = F.replace(F.lit(pattern), F.lit("{key}"), F.col("citation_key"))
        return F.replace(out, F.lit("{source}"), F.col("source")) if "source" in by else out

    asked = entries.select(*by).distinct().select(*by, F.posexplode(F.array(*map(filled, names))).alias("_at", "name"))
    found = asked.join(files.select("name", "path"), "name").groupBy(*by).agg(F.min_by(F.struct("path", "name"), F.struct("_at", "path")).alias("x"))
    return entries.join(found.select(*by, "x.path", "x.name"), by)


def bibtex_for(entries: DataFrame, files: DataFrame, normal: bool = True) -> DataFrame:
    """citation_key, path, method, issue, evidence: an entry's BibTeX file by its name, or else by its title.

    entries: citation_key, expected_title; files: path, name, title (of its entry). Titles are joined in normal form;
    several files of one title are ambiguous, and none is taken.
    """
    exact = by_key(entries.select("citation_key"), files, BIBTEX_FILES).select("citation_key", "path", F.lit("citation_key_file").alias("method"))
    rest = entries.join(exact, "citation_key", "left_anti")
    titled = files.where(present(F.col("title")) & F.regexp_like("name", F.lit(r"\.(?:bib|bibtex)$"))).select(normalize_title(F.col("title"), normal).alias("_t"), "path")
    j = rest.select("citation_key", normalize_title(F.col("expected_title"), normal).alias("_t")).join(titled, "_t")
    # files of one title for one entry
    found = j.groupBy("citation_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    one = F.col("n") == 1
    found = found.select("citation_key", F.when(one, F.col("paths")[0]).alias("path"), F.when(one, "title_exact").alias("method"), F.when(~one, "BIBTEX_PROVENANCE_AMBIGUOUS").alias("issue"), F.when(~one, F.col("paths")).alias("evidence"))
    return exact.unionByName(found, allowMissingColumns=True)


def source_map_of(files: DataFrame, keys: DataFrame, folder: str, output: str) -> DataFrame:
    """citation_key, source_text, source_label, evidence_kind, path of .pdf and .txt files that are named by a cited key.

    Places are relative to the map's folder if that lies in or beside the sources' folder, or holds it.
    """
    root, target = normpath(folder), normpath(dirname(output) or ".")
    beside = dirname(root)
    inside = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    rest = F.substr(F.col("path"), F.lit(len(root) + 2))
    text = F.concat(F.lit(relpath(root, target) + "/"), rest) if inside(target, beside) or inside(beside, target) else F.col("path")
    own = named(files).where(F.col("suffix").isin(".pdf", ".txt")).withColumn("citation_key", F.col("stem"))
    own = own.join(keys.select("citation_key").distinct(), "citation_key", "left_semi")
    return own.select("citation_key", text.alias("source_text"), F.concat(F.lit(root.rsplit("/", 1)[-1] + "/"), rest).alias("source_label"), F.lit("source_text").alias("evidence_kind"), "path").orderBy("path")


# --- the check ----------------------------------------------------------------------------------------


def pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Queries beside their candidates, with the columns that the resolver takes."""
    q = queries.select("query_id", F.col("title").alias("q_title"), F.col("authors").alias("q_authors"), F.col("year").alias("q_year"), F.col("doi").alias("q_doi"), F.col("arxiv_id").alias("q_arxiv_id"))
    return candidates.join(q, "query_id")


def reference_check(lock: DataFrame, candidates: DataFrame, live: DataFrame | None = None, keys: list[str] | None = None, most: int | None = None, normal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(decisions, issues) of lock entries against what files, saved pages and lookups have of them.

    candidates: query_id (a citation key), ord and a candidate's columns, of all origins; live: citation_key, source, ok,
    error of the lookups that were made. Failed lookups block only entries that nothing resolved. ``keys`` are taken
    first, then the first ``most`` entries by ord.
    """
    if keys:
        lock = lock.where(F.col("citation_key").isin(keys))
    if most is not None:
        lock = lock.orderBy("ord").limit(most)
    asked = locks.query_of(lock)
    d = resolve.decide(asked, resolve.best(resolve.score(pairs(asked, candidates), normal))).withColumnRenamed("query_id", "citation_key")
    codes = d.where("issue is not null").select("citation_key", F.col("issue").alias("code"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    none = d.where("issue = 'NO_CANDIDATES'").select("citation_key", F.lit("REFERENCE_CANDIDATES_MISSING").alias("code"), F.array().cast("array<string>").alias("evidence"))
    if live is not None:
        none = none.join(live.select("citation_key").distinct(), "citation_key", "left_anti")
        failed = live.where("not ok and error is not null").join(d.where("issue is not null").select("citation_key"), "citation_key", "left_semi")
        codes = codes.unionByName(failed.select("citation_key", F.lit("REFERENCE_LIVE_LOOKUP_FAILED").alias("code"), F.array("error").alias("evidence")))
    return d, codes.unionByName(none).select("code", F.lit("blocking").alias("severity"), "citation_key", "evidence")


def provenance(selected: DataFrame, exports: DataFrame, files: DataFrame, fallback_reason: str | None = None, as_of: str | None = None, normal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(selected with bibtex, issues): the BibTeX of selected records, from an export, a file, or the preprint itself.

    selected: citation_key, status, authority, and a candidate's columns; exports and files: path, name, title, doi, text.
    An export counts only where the authority has an export address and its checks hold; a file stands for one there
    too, unless there is a reason for a fallback.
    """
    from provlake.sources.parsers import bibtex_record

    entries = selected.withColumn("source", F.col("authority.source"))
    told = entries.where(present(F.col("authority.bibtex_url"))).select("citation_key", "source")
    own = by_key(told, exports, EXPORT_FILES).select("citation_key", F.col("path").alias("_export"))
    other = bibtex_for(entries.select("citation_key", F.col("c_title").alias("expected_title")), files, normal).select("citation_key", "path", "method", F.col("issue").alias("_issue"))
    rows = entries.join(own, "citation_key", "left").join(other, "citation_key", "left")
    both = exports.select("path", "title", "doi", "text").unionByName(files.select("path", "title", "doi", "text")).dropDuplicates(["path"])
    rows = rows.withColumn("_path", F.coalesce("_export", "path")).drop("path").join(both.select(F.col("path").alias("_path"), F.col("title").alias("b_title"), F.col("doi").alias("b_doi"), F.col("text").alias("_text")), "_path", "left")
    official = F.col("_path").isNotNull() & (F.col("_export").isNotNull() | (present(F.col("authority.bibtex_url")) & F.lit(not fallback_reason)))
    rows = records.export_checks(rows.withColumns({"_official": official, "expected_title": F.col("c_title")}), normal)
    fine = ~F.col("_official") | (F.size("issues") == 0)
    filed = F.when(F.col("_official"), bibtex_record(F.col("_text"))).otherwise(bibtex_record(F.col("_text"), "publisher_metadata_manual_normalized"))
    rows = records.arxiv_bibtex(rows, F.col("citation_key"), as_of, normal).withColumnRenamed("bibtex", "_preprint")
    preprint = F.col("_path").isNull() & (F.col("status") == "arxiv_fallback_verified")
    rows = rows.withColumn("bibtex", F.when(F.col("_path").isNotNull() & fine, filed).when(preprint, F.col("_preprint")))
    codes = F.concat(F.when(F.col("_official"), F.col("issues")).otherwise(F.array().cast("array<string>")), F.filter(F.array(F.when(F.col("_export").isNull(), F.col("_issue")), F.when(F.col("bibtex").isNull(), F.lit("BIBTEX_PROVENANCE_INPUT_MISSING"))), lambda x: x.isNotNull()))
    issues = rows.select(F.explode(codes).alias("code"), F.lit("blocking").alias("severity"), "citation_key")
    kept = [c for c in selected.columns if c != "source"]
    return rows.select(*kept, "b_doi", F.when(F.col("_export").isNotNull(), "official_bibtex_fixture").otherwise(F.col("method")).alias("method"), F.when(F.col("_official"), F.col("title_check")).alias("title_check"), F.when(F.col("_official"), F.col("doi_check")).alias("doi_check"), "bibtex"), issues
