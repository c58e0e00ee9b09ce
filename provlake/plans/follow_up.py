"""Queries of actions, gates and roll-ups, over stand-ins made of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.operators import actions, audit, rollup
from provlake.plans.publishing import docs, entries, said
from provlake.plans.registry import BIB_SQL, FAILURE_SQL, _issues, lookups, query, quoted
from provlake.session import table


def flagged(code: str, flag: int) -> str:
    """A CASE of an action's flag, by the table of actions."""
    return f"CASE {code} " + " ".join(f"WHEN '{c}' THEN {str(a[flag]).lower()}" for c, a in actions.ACTIONS.items()) + " END"


# --- actions ------------------------------------------------------------------------------------------


def reference_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Issues of a reference check of the documents, some told twice, and the decisions."""
    i, d = F.col("doc_id"), docs(spark, sf_dir)
    codes = [c for c, _ in actions.REFERENCE_RULES]
    issues = d.select(i.alias("ord"), F.get(F.array(*map(F.lit, [*codes, "OTHER"])), (i % 8).cast("int")).alias("code"), said("k", i).alias("citation_key"))
    issues = issues.unionByName(issues.withColumn("ord", F.col("ord") + 1_000_000))
    decisions = d.select(said("k", i).alias("citation_key"), F.lit("blocked").alias("decision"), F.struct(F.lit("acl").alias("source"), F.when(i % 16 == 6, said("https://b/", i)).alias("bibtex_url")).alias("authority"))
    return issues, decisions


REFERENCE_ACTIONS_SQL = f"""WITH a AS (SELECT doc_id, unnest(CASE doc_id % 8 WHEN 0 THEN ['ADD_REFERENCE_CANDIDATES'] WHEN 1 THEN ['ADD_REFERENCE_CANDIDATES'] WHEN 2 THEN ['REVIEW_REFERENCE_CANDIDATE'] WHEN 3 THEN ['REVIEW_REFERENCE_CANDIDATE'] WHEN 4 THEN ['RETRY_OR_CACHE_LIVE_LOOKUP', 'ADD_OFFICIAL_HTML_FIXTURE']
  WHEN 5 THEN ['ADD_OFFICIAL_BIBTEX_FIXTURE'] WHEN 6 THEN CASE WHEN doc_id % 16 = 6 THEN ['FETCH_OFFICIAL_BIBTEX_EXPORT', 'ADD_BIBTEX_PROVENANCE'] ELSE ['ADD_BIBTEX_PROVENANCE'] END ELSE CAST([] AS VARCHAR[]) END) AS code FROM documents)
SELECT code, 'k' || doc_id AS citation_key, {flagged('code', 1)} AS human, {flagged('code', 2)} AS writes, {flagged('code', 3)} AS network, CASE code WHEN 'ADD_BIBTEX_PROVENANCE' THEN CASE WHEN doc_id % 16 = 6 THEN 'official_bibtex_export' ELSE 'reviewed_manual_fallback_or_official_fixture' END END AS preferred,
  'python -m provlake reference-check --lock ''my lock''' || CASE code WHEN 'ADD_REFERENCE_CANDIDATES' THEN ' --candidate-dir REFERENCE_CANDIDATES_DIR --json' WHEN 'REVIEW_REFERENCE_CANDIDATE' THEN ' --candidate-dir REFERENCE_CANDIDATES_DIR --json' WHEN 'RETRY_OR_CACHE_LIVE_LOOKUP' THEN ' --prefer-cache --live --json'
  WHEN 'ADD_OFFICIAL_HTML_FIXTURE' THEN ' --bibtex-dir REVIEWED_FALLBACK_BIBTEX_DIR --fixture-html-dir OFFICIAL_HTML_DIR --fallback-reason ''Reviewed saved official HTML; manual BibTeX fallback retained because no official BibTeX endpoint was verified.'' --citation-key k' || doc_id || ' --json'
  WHEN 'ADD_OFFICIAL_BIBTEX_FIXTURE' THEN ' --official-bibtex-dir OFFICIAL_BIBTEX_DIR --citation-key k' || doc_id || ' --json' WHEN 'FETCH_OFFICIAL_BIBTEX_EXPORT' THEN ' --citation-key k' || doc_id || ' --fetch-official-bibtex --json'
  ELSE ' --bibtex-dir REVIEWED_FALLBACK_BIBTEX_DIR --official-bibtex-dir OFFICIAL_BIBTEX_DIR --json' END AS command FROM a"""


@query(REFERENCE_ACTIONS_SQL)
def reference_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions.reference_actions(*reference_state(spark, sf_dir), "my lock")
    return a.select("code", "citation_key", F.col("requires_human_review").alias("human"), F.col("writes_files").alias("writes"), F.col("network_required").alias("network"), F.col("preferred_input").alias("preferred"), "command")


def audit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects, each in another state of its audit."""
    i = F.col("doc_id")
    codes = F.array_compact(F.array(F.when(i % 2 == 0, "OFFICIAL_EXPORT_CONTENT_CHANGED"), F.when(i % 3 == 0, "CLAIM_NOT_CHECKED"), F.when(i % 7 == 0, "TEX_INCLUDE_MISSING")))
    none = F.array().cast("array<string>")
    return docs(spark, sf_dir).select(
        i.alias("project"), codes.alias("blocking"), (i % 5).alias("work_items"), F.array(said("k", i)).alias("work_keys"), (i % 4 < 2).alias("checked"), F.when(i % 11 == 0, F.array(F.lit("m"))).otherwise(none).alias("missing_keys"),
        F.when(i % 13 == 0, F.array(F.lit("claim-1"))).otherwise(none).alias("no_match"), F.when(i % 17 == 0, 1).otherwise(0).alias("updated"), (i % 10 == 0).alias("handed_off"),
    )


@query(
    """SELECT doc_id AS project, code, CAST(ord AS INTEGER) AS ord FROM (SELECT doc_id, unnest(['SYNC_BIBTEX', 'RESOLVE_REFERENCE_PROVENANCE', 'MAP_CLAIM_SOURCES', 'ADD_MISSING_SOURCE_FILES', 'REVIEW_NO_MATCH_CLAIMS', 'EXPORT_REVIEW_BUNDLE', 'REVIEW_CLAIM_EVIDENCE', 'EXPORT_HANDOFF']) AS code, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS ord FROM documents) z
WHERE CASE ord WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN doc_id % 5 > 0 WHEN 2 THEN doc_id % 4 >= 2 AND doc_id % 3 = 0 WHEN 3 THEN doc_id % 4 < 2 AND doc_id % 11 = 0 WHEN 4 THEN doc_id % 4 < 2 AND doc_id % 13 = 0
  WHEN 7 THEN doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 10 <> 0 ELSE doc_id % 4 < 2 AND (doc_id % 17 = 0 OR doc_id % 3 = 0) END"""
)
def audit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.audit_actions(audit_state(spark, sf_dir), {"tex": "p.tex", "bib": "p.bib", "lock": "l.json", "claims": "c.tsv"}).select("project", "code", "ord")


@query(
    f"""WITH f AS (SELECT event_id, event_type, {FAILURE_SQL} AS code FROM events WHERE event_id % 7 <> 0)
SELECT event_id AS ord, CASE code WHEN 'NO_CANDIDATES' THEN 'REVIEW_LIVE_SMOKE_NO_CANDIDATES' WHEN 'LIVE_SMOKE_RATE_LIMITED' THEN 'RETRY_LIVE_SMOKE_RATE_LIMITED' WHEN 'LIVE_SMOKE_NETWORK_UNAVAILABLE' THEN 'RETRY_LIVE_SMOKE_AFTER_NETWORK_AVAILABLE' ELSE 'RETRY_LIVE_SMOKE_DISCOVERY' END AS code,
  'python -m provlake live-smoke --source ' || event_type || ' --title ''a title'' --author ''Ann Lee'' --cache-root cache' || CASE code WHEN 'NO_CANDIDATES' THEN ' --prefer-cache' WHEN 'LIVE_SMOKE_RATE_LIMITED' THEN ' --prefer-cache --min-interval-seconds 5 --retry 4 --retry-after-seconds 10' ELSE '' END
  || CASE code WHEN 'LIVE_SMOKE_RATE_LIMITED' THEN '' ELSE ' --retry 4' END || ' --live --json' AS command FROM f"""
)
def lookup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups(spark, sf_dir).withColumns({"title": F.lit("a title"), "query_id": F.lit(None).cast("string"), "citation_key": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "doi": F.lit(""), "arxiv_id": F.lit(None).cast("string"), "authors": F.array(F.lit("Ann Lee")), "preferred_venues": F.array().cast("array<string>")})
    return actions.lookup_actions(rows, retry=4).select("ord", "code", "command")


def planned_events(spark: SparkSession, sf_dir: str, **gates) -> DataFrame:
    """Events as actions, each user's a manifest."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    codes = list(actions.ACTIONS)
    rows = e.select(
        F.col("user_id").alias("manifest"), i.alias("ord"), F.get(F.array(*map(F.lit, codes)), (i % len(codes)).cast("int")).alias("code"), F.lit("").alias("citation_key"),
        F.when(i % 10 == 0, "").when(i % 10 == 1, "run --lock 'LOCK' x").otherwise("run it").alias("command"),
    )
    return actions.planned(rows.select("*", *actions.acted(F.col("code"))), **gates)


PLAN_SQL = f"""WITH e AS (SELECT user_id AS manifest, event_id AS ord, [{quoted(list(actions.ACTIONS))}][event_id % {len(actions.ACTIONS)} + 1] AS code FROM events),
f AS (SELECT *, {flagged('code', 1)} AS human, {flagged('code', 2)} AS writes, {flagged('code', 3)} AS network FROM e),
g AS (SELECT *, CASE WHEN ord % 10 = 0 THEN 'command_missing' WHEN ord % 10 = 1 THEN 'input_required' WHEN network THEN 'network_required' WHEN human THEN 'requires_human_review' END AS reason FROM f),
h AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY manifest ORDER BY ord ROWS UNBOUNDED PRECEDING) AS n FROM g),
p AS (SELECT manifest, ord, code, CASE WHEN reason IS NULL AND n > 2 THEN 'max_actions' ELSE reason END AS skip_reason FROM h)
"""


@query(PLAN_SQL + "SELECT manifest, ord, code, skip_reason, skip_reason IS NULL AS selected FROM p")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned_events(spark, sf_dir, allow_writes=True, most=2).select("manifest", "ord", "code", "skip_reason", "selected")


@query(PLAN_SQL + "SELECT manifest, count(*) AS actions, count(*) FILTER (WHERE skip_reason IS NULL) AS selected, count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped FROM p GROUP BY 1")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.plan_counts(planned_events(spark, sf_dir, allow_writes=True, most=2)).select("manifest", "actions", "selected", "skipped")


@query(
    PLAN_SQL
    + """, s AS (SELECT manifest, min(ord) FILTER (WHERE skip_reason IS NULL) AS a, min(ord) FILTER (WHERE ord % 10 <> 0) AS b FROM p GROUP BY 1)
SELECT s.manifest, CASE WHEN a IS NOT NULL THEN 'ready' WHEN b IS NOT NULL THEN 'blocked' ELSE 'none' END AS state, p.code FROM s LEFT JOIN p ON s.manifest = p.manifest AND p.ord = coalesce(a, b)"""
)
def next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.next_step(planned_events(spark, sf_dir, allow_writes=True, most=2)).select("manifest", "state", "code")


@query(PLAN_SQL + "SELECT CASE WHEN skip_reason IS NULL THEN CASE ord % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'planned_not_executed' END ELSE 'skipped_' || skip_reason END AS status, count(*) AS n FROM p GROUP BY 1")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = planned_events(spark, sf_dir, allow_writes=True, most=2), F.col("ord")
    return actions.manifest_summary(p.withColumns({"executed": F.col("selected") & (i % 3 < 2), "returncode": F.when(i % 3 == 1, 2)}))


MONITORED = "(doc_id % 4 IN (1, 2) OR doc_id % 6 = 0)"


@query(
    f"""SELECT 'k' || doc_id AS citation_key, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'crossref' END, CASE WHEN doc_id % 2 = 0 THEN 'acl' END, CASE WHEN doc_id % 7 <> 0 THEN 'crossref' END) AS sources,
  'python -m provlake reference-check --lock l.json ' || concat_ws(' ', CASE WHEN doc_id % 7 = 0 THEN '--source crossref' END, CASE WHEN doc_id % 2 = 0 THEN '--source acl' END, CASE WHEN doc_id % 7 <> 0 THEN '--source crossref' END) || ' --cache-root cache --citation-key k' || doc_id || ' --fetch-official-bibtex --live --json' AS command FROM documents WHERE {MONITORED}"""
)
def monitor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.monitor_plan(entries(spark, sf_dir), "l.json")[0].select("citation_key", F.array_join("sources", ",").alias("sources"), "command")


@query(f"SELECT 'k' || doc_id AS citation_key FROM documents WHERE NOT {MONITORED}")
def monitor_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.monitor_plan(entries(spark, sf_dir), "l.json")[1].select("citation_key")


# --- roll-ups -----------------------------------------------------------------------------------------


@query("SELECT CASE WHEN count(DISTINCT event_type) = 1 THEN max(event_type) ELSE 'mixed' END AS source, count(*) AS queries, count(*) FILTER (WHERE event_id < 500) AS run, count(*) FILTER (WHERE event_id >= 500) AS skipped, count(*) FILTER (WHERE event_id < 500 AND event_id % 7 = 0) AS ok_count, false AS all_ok FROM events")
def suite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.suite_counts(lookups(spark, sf_dir), 500)


@query("SELECT event_type AS source, count(*) AS queries, count(*) FILTER (WHERE event_id < 500) AS run FROM events GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.source_counts(lookups(spark, sf_dir), 500)


def told_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims' issues, with the claim's number in the message."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    code = F.when(i % 3 == 0, "CLAIM_NOT_CHECKED").when(i % 3 == 1, "CLAIM_EVIDENCE_MISSING").otherwise("OTHER")
    return e.select(i.alias("ord"), code.alias("code"), F.when(i % 2 == 0, "blocking").otherwise("warning").alias("severity"), audit.message(code, said("claim-", F.col("user_id"))).alias("message"), F.col("event_type").alias("citation_key"), F.array(F.col("user_id").cast("string")).alias("evidence"))


@query("SELECT event_id AS ord FROM events e WHERE event_id % 3 <> 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 = 1)")
def without_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.without_redundant(told_claims(spark, sf_dir)).select("ord")


@query("SELECT min(event_id) AS ord FROM events GROUP BY event_id % 3, event_id % 2, event_type, user_id")
def distinct_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.distinct_issues(told_claims(spark, sf_dir)).select("ord")


@query(
    """WITH e AS (SELECT event_id, event_type, ['CLAIM_NOT_CHECKED', 'CLAIM_EVIDENCE_MISSING', 'OTHER'][event_id % 3 + 1] AS code FROM events), k AS (SELECT code, event_type, min(event_id) AS m FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY m, event_type) AS r FROM k),
s AS (SELECT code, string_agg(CASE WHEN r <= 2 THEN event_type END, ',' ORDER BY r) AS sample, greatest(count(*) - 2, 0) AS omitted FROM r GROUP BY 1)
SELECT e.code, CASE e.code WHEN 'CLAIM_NOT_CHECKED' THEN 'Claims are not marked checked.' WHEN 'CLAIM_EVIDENCE_MISSING' THEN 'Claims have no evidence text.' ELSE '' END AS message, count(*) AS n, any_value(sample) AS sample, any_value(omitted) AS omitted FROM e JOIN s ON e.code = s.code GROUP BY 1, 2"""
)
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.issue_groups(told_claims(spark, sf_dir), sample=2).drop("ord")


@query(BIB_SQL + f"SELECT code, severity, count(*) AS n, CASE code {' '.join(f'''WHEN '{c}' THEN '{m}' ''' for c, m in K.MESSAGES.items() if '{}' not in m and c in ('MISSING_LOCK_ENTRY', 'OFFICIAL_EXPORT_NOT_USED', 'OFFICIAL_EXPORT_CONTENT_CHANGED', 'OFFICIAL_EXPORT_CHECKSUM_MISSING', 'TITLE_MISMATCH', 'YEAR_MISMATCH', 'AUTHOR_MISMATCH', 'FALLBACK_REASON_MISSING', 'ARXIV_ACCESSED_DATE_MISSING', 'ARXIV_FALLBACK', 'DOI_MISSING', 'LOCK_ENTRY_NOT_IN_BIB'))} ELSE 'other' END AS message FROM issues GROUP BY 1, 2")
def issue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _issues(spark, sf_dir)
    said_ = F.when(F.col("code").isin("NON_PASSING_STATUS", "UNVERIFIED_BIBTEX_SOURCE"), "other").otherwise(audit.message(F.col("code")))
    return rollup.issue_summary(rows.withColumn("message", said_)).select("code", "severity", "n", "message")
