"""The audit of whole papers, over projects of fifty documents each, and the SQL that its issues must agree with.

Documents are bibliography entries, labels are lock entries, and every document is a claim whose whole text meets its quote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.operators import paper
from provlake.plans.registry import TERMS_SQL, query, quoted
from provlake.session import table
from provlake.sources import loaders


def text_of(*parts: object) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    return d.withColumn("project", text_of("p", F.floor(i / 50)))


def _bibs(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    title = F.when(i % 6 == 0, "Other ").otherwise("Xqzvtitle ")
    doi = F.when(i % 7 != 0, text_of(", doi = {10.1/d", i, "}")).otherwise("")
    entry = text_of("@misc{d", i, ", title = {", title, i, "}, year = {", F.col("n_chars"), "}, author = {Lee, Ann and Bo Li}", doi, "}\n")
    rows = d.where("doc_id % 17 <> 0").groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    return d.select("project").distinct().join(rows, "project", "left").select("project", F.coalesce("text", F.lit("")).alias("text"))


def _lock(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(d.select("doc_id", "project", "n_chars"), "doc_id")
    year = (F.col("n_chars") + F.when(i % 9 == 0, 1).otherwise(0)).cast("string")
    kind = F.when(F.col("toxic") == 1, "unknown").when(i % 3 == 0, "official_export").otherwise("arxiv_manual_normalized")
    entry = F.to_json(
        F.struct(
            text_of("d", i).alias("citation_key"),
            F.when(F.col("quality") == 1, "verified_official_bibtex").otherwise("draft").alias("status"),
            F.struct(text_of("Xqzvtitle ", i).alias("title"), F.array(F.when(i % 8 == 0, "Bob").otherwise("Ann Lee")).alias("authors"), year.alias("year"), F.when(i % 4 != 0, text_of("10.1/d", i)).alias("doi")).alias("record"),
            F.struct(F.when(i % 5 == 0, text_of("https://x/", i)).alias("bibtex_url")).alias("authority"),
            F.struct(kind.alias("source_kind"), F.lit("placeholder").alias("normalized_sha256")).alias("bibtex"),
        )
    )
    return lab.select("project", i.cast("int").alias("ord"), F.from_json(entry, loaders.LOCK_ENTRY).alias("e")).select("project", "ord", "e.*")


def _tex(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    number = F.substring("project", 2, 20).cast("long")
    keys = d.where("doc_id % 3 <> 0").groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(text_of("d", i))), ",").alias("keys"))
    body = F.concat(F.lit("Words \\cite{"), F.coalesce("keys", F.lit("")), F.when(number % 2 == 0, ",gone").otherwise(""), F.lit("}."), F.when(number % 5 == 0, "\n\\input{lost}").otherwise(""))
    return d.select("project").distinct().join(keys, "project", "left").select("project", F.lit("m.tex").alias("path"), body.alias("text"))


def _claims(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    quote = F.when(i % 4 == 0, "").when(i % 4 == 1, text_of(F.col("text"), " might")).when(i % 4 == 2, "unrelated wording").otherwise(F.col("text"))
    own = {
        "claim_id": text_of("claim-", i),
        "claim_text": F.when(i % 3 == 0, text_of(F.col("text"), " outperforms")).otherwise(F.col("text")),
        "citation_key": text_of("d", i),
        "status": F.when(i % 10 == 0, "checked").when(i % 10 == 1, "too_strong").when(i % 10 == 2, "draft").otherwise(""),
        "source_location": F.when(i % 20 != 0, "p1").otherwise(""),
        "quote_or_evidence": quote,
        "evidence_kind": F.when(i % 30 == 10, "Abstract").otherwise("source text"),
    }
    return d.select("project", i.alias("ord"), *(own.get(c, F.lit("")).alias(c) for c in loaders.CLAIM_COLUMNS))


PAPER_SQL = f"""
WITH d AS (SELECT doc_id AS i, 'p' || (doc_id // 50) AS project, doc_id // 50 AS p, coalesce(text, '') AS text, n_chars, 'd' || doc_id AS k, 'claim-' || doc_id AS c FROM documents),
l AS (SELECT d.*, quality, CASE WHEN toxic = 1 THEN 'unknown' WHEN i % 3 = 0 THEN 'official_export' ELSE 'arxiv_manual_normalized' END AS kind, i % 17 <> 0 AS listed FROM labels JOIN d ON doc_id = i),
both_ AS (SELECT * FROM l WHERE listed),
n AS (SELECT *, CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN text || ' might' WHEN 2 THEN 'unrelated wording' ELSE text END AS quote, CASE WHEN i % 3 = 0 THEN text || ' outperforms' ELSE text END AS said,
  CASE i % 10 WHEN 0 THEN 'checked' WHEN 1 THEN 'too_strong' WHEN 2 THEN 'draft' ELSE 'claim_unchecked' END AS status FROM d),
t AS (SELECT *, regexp_replace(quote, '^[\\s]+|[\\s]+$', '', 'g') <> '' AS has, list_sort(list_intersect(cs, es)) AS shared, list_sort(list_intersect(cs, [{quoted(K.STRONG_TERMS)}])) AS strong, len(list_intersect(es, [{quoted(K.HEDGE_TERMS)}])) > 0 AS hedged
  FROM (SELECT *, {TERMS_SQL % 'said'} AS cs, {TERMS_SQL % 'quote'} AS es FROM n)),
claims_of AS (SELECT *, CASE WHEN NOT has THEN 'CLAIM_EVIDENCE_MISSING' WHEN len(shared) < 2 THEN 'CLAIM_EVIDENCE_LOW_OVERLAP' END AS lacks, has AND len(strong) > 0 AND (len(shared) < 3 OR hedged) AS too_strong,
  CASE WHEN status <> 'checked' THEN 0 WHEN i % 20 = 0 THEN 1 WHEN NOT has THEN 2 WHEN i % 30 = 10 THEN 3 END AS fault FROM t),
whole AS (
  SELECT project, 'MISSING_LOCK_ENTRY' AS code, 'blocking' AS severity, 'BibTeX entry has no lockfile entry.' AS message, k AS citation_key, [] AS evidence FROM d WHERE i % 17 <> 0 AND i NOT IN (SELECT l.i FROM l)
  UNION ALL SELECT project, 'NON_PASSING_STATUS', 'blocking', 'Lockfile status is draft.', k, [] FROM both_ WHERE quality IS DISTINCT FROM 1
  UNION ALL SELECT project, 'UNVERIFIED_BIBTEX_SOURCE', 'blocking', 'BibTeX source kind is unknown.', k, [] FROM both_ WHERE kind = 'unknown'
  UNION ALL SELECT project, 'OFFICIAL_EXPORT_NOT_USED', 'blocking', 'Official BibTeX endpoint exists, but entry is not marked as official export.', k, ['https://x/' || i] FROM both_ WHERE i % 5 = 0 AND kind <> 'official_export'
  UNION ALL SELECT project, 'OFFICIAL_EXPORT_CHECKSUM_MISSING', 'warning', 'Official BibTeX export has no reviewed checksum in the lockfile.', k, [] FROM both_ WHERE kind = 'official_export'
  UNION ALL SELECT project, 'TITLE_MISMATCH', 'blocking', 'BibTeX title does not match lockfile record title.', k, ['Other ' || i, 'Xqzvtitle ' || i] FROM both_ WHERE i % 6 = 0
  UNION ALL SELECT project, 'YEAR_MISMATCH', 'blocking', 'BibTeX year does not match lockfile record year.', k, [CAST(n_chars AS VARCHAR), CAST(n_chars + 1 AS VARCHAR)] FROM both_ WHERE i % 9 = 0
  UNION ALL SELECT project, 'AUTHOR_MISMATCH', 'blocking', 'BibTeX first author does not match lockfile record first author.', k, ['Lee, Ann', 'Bob'] FROM both_ WHERE i % 8 = 0
  UNION ALL SELECT project, 'FALLBACK_REASON_MISSING', 'warning', 'Manual fallback BibTeX requires a fallback reason.', k, [] FROM both_ WHERE kind = 'arxiv_manual_normalized'
  UNION ALL SELECT project, 'ARXIV_ACCESSED_DATE_MISSING', 'warning', 'arXiv fallback entry requires an accessed date.', k, [] FROM both_ WHERE kind = 'arxiv_manual_normalized'
  UNION ALL SELECT project, 'ARXIV_FALLBACK', 'warning', 'Entry uses arXiv fallback rather than final publication BibTeX.', k, [] FROM both_ WHERE kind = 'arxiv_manual_normalized'
  UNION ALL SELECT project, 'DOI_MISSING', 'warning', 'Lockfile record has no DOI.', k, [] FROM both_ WHERE i % 4 = 0
  UNION ALL SELECT project, 'DOI_MISSING', 'warning', 'BibTeX entry is missing DOI present in the lockfile record.', k, ['10.1/d' || i] FROM both_ WHERE i % 4 <> 0 AND i % 7 = 0
  UNION ALL SELECT project, 'LOCK_ENTRY_NOT_IN_BIB', 'warning', 'Lockfile entry is not present in the BibTeX file.', k, [] FROM l WHERE NOT listed
  UNION ALL SELECT DISTINCT project, 'TEX_INCLUDE_MISSING', 'warning', 'Referenced TeX include file is missing.', NULL, ['lost.tex'] FROM d WHERE p % 5 = 0
  UNION ALL SELECT project, 'CITATION_NOT_IN_BIB', 'blocking', 'Citation key appears in manuscript but is missing from the BibTeX file.', k, [] FROM d WHERE i % 3 <> 0 AND i % 17 = 0
  UNION ALL SELECT DISTINCT project, 'CITATION_NOT_IN_BIB', 'blocking', 'Citation key appears in manuscript but is missing from the BibTeX file.', 'gone', [] FROM d WHERE p % 2 = 0
  UNION ALL SELECT project, 'BIB_ENTRY_NOT_CITED', 'warning', 'BibTeX entry is not cited in the manuscript.', k, [] FROM d WHERE i % 3 = 0 AND i % 17 <> 0
  UNION ALL SELECT project, 'CLAIM_NOT_CHECKED', CASE WHEN status = 'draft' THEN 'warning' ELSE 'blocking' END, 'Claim ' || c || ' is marked ' || status || '.', k, [] FROM claims_of WHERE fault = 0 AND lacks IS NULL AND NOT too_strong
  UNION ALL SELECT project, 'CLAIM_SOURCE_LOCATION_MISSING', 'warning', 'Claim ' || c || ' is checked but has no source location.', k, [] FROM claims_of WHERE fault = 1
  UNION ALL SELECT project, 'CLAIM_EVIDENCE_MISSING', 'warning', 'Claim ' || c || CASE WHEN fault = 2 THEN ' is checked but' ELSE '' END || ' has no evidence text.', k, [] FROM claims_of WHERE fault = 2 OR lacks = 'CLAIM_EVIDENCE_MISSING'
  UNION ALL SELECT project, 'CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE', 'blocking', 'Claim ' || c || ' is marked checked using weak evidence kind Abstract.', k, ['Abstract'] FROM claims_of WHERE fault = 3
  UNION ALL SELECT project, 'CLAIM_EVIDENCE_LOW_OVERLAP', 'warning', 'Claim ' || c || ' has low lexical overlap with its evidence.', k, shared FROM claims_of WHERE lacks = 'CLAIM_EVIDENCE_LOW_OVERLAP'
  UNION ALL SELECT project, 'CLAIM_MAY_BE_TOO_STRONG', 'warning', 'Claim ' || c || ' uses strong wording that needs careful source support.', k, strong FROM claims_of WHERE too_strong
  UNION ALL SELECT project, 'SOURCE_TEXT_MISSING_FOR_CITATION', 'blocking', 'No source text/PDF was mapped for a cited claim.', k, [] FROM claims_of WHERE NOT has AND i % 8 <> 4
  UNION ALL SELECT project, 'CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE', 'blocking', 'Mapped source text was provided, but no overlapping evidence block was found.', k, [c] FROM claims_of WHERE NOT has AND i % 8 = 4
  UNION ALL SELECT project, 'SOURCE_TITLE_LOCK_ENTRY_MISSING', 'blocking', 'Source title check could not find a matching lockfile entry.', k, ['/s/' || i || '.txt'] FROM d WHERE i % 8 = 4 AND i NOT IN (SELECT l.i FROM l))
SELECT project, code, severity, message, citation_key, array_to_string(evidence, '|') AS evidence FROM whole
"""


@query(PAPER_SQL)
def paper_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = _projects(spark, sf_dir)
    tex, claims = _tex(d), _claims(d)
    mapped = d.where("doc_id % 8 = 4").withColumn("path", text_of("/s/", i, ".txt"))
    sources = mapped.select("project", i.cast("int").alias("ord"), text_of("d", i).alias("citation_key"), F.col("path").alias("source_text"), F.col("path").alias("source_text_raw"), F.col("path").alias("source_label"), F.lit("source_text").alias("evidence_kind"))
    texts = mapped.select("path", text_of("Xqzvtitle ", i, "\n\n123 456").alias("text"))
    found = paper.paper_audit(_bibs(d), _lock(spark, sf_dir, d), tex, tex.select("project", "path"), claims, sources, texts)
    return found["issues"].select("project", "code", "severity", "message", "citation_key", F.array_join("evidence", "|").alias("evidence"))
