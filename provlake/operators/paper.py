"""The audit of manuscripts as a whole: bibliography, lock, TeX, claims and sources of many projects in one job.

Keys of different projects must not meet, so inside the audit a key carries its project; issues come out with both apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.text import citation_keys
from provlake.operators import actions, audit, claim_sources, rollup, titles
from provlake.operators.locks import work_items
from provlake.session import checkpointed
from provlake.sources import parsers

#: Between a project and a key; in neither.
BETWEEN = "\x1f"
ISSUE = ["project", "ord", "code", "severity", "message", "citation_key", "evidence"]


def own(key: str | Column, project: str = "project") -> Column:
    return F.concat(project, F.lit(BETWEEN), F.col(key) if isinstance(key, str) else key)


def own_list(keys: str = "citation_key") -> Column:
    """A list of keys, each with its project."""
    return F.array_join(F.transform(citation_keys(F.col(keys)), lambda k: own(k)), ",")


def told(rows: DataFrame, stage: int, place: Column) -> DataFrame:
    """Issue rows in their common form, with message and evidence as they are; what has no message says its code's.

    What has project apart keeps it, else it is taken from the key.
    """
    if "project" not in rows.columns:
        rows = rows.withColumn("project", F.split_part("citation_key", F.lit(BETWEEN), F.lit(1)))
    key = F.when(F.contains("citation_key", F.lit(BETWEEN)), F.array_join(F.transform(F.split("citation_key", ","), lambda k: F.element_at(F.split(k, BETWEEN), -1)), ",")).otherwise(F.col("citation_key"))
    said = F.col("message") if "message" in rows.columns else audit.message(F.col("code"))
    evidence = F.col("evidence") if "evidence" in rows.columns else F.array().cast("array<string>")
    ord_ = F.struct(F.lit(stage).alias("stage"), place.cast("string").alias("place"), (F.col("ord").cast("long") if "ord" in rows.columns else F.lit(0).cast("long")).alias("check"))
    return rows.select("project", ord_.alias("ord"), "code", "severity", said.alias("message"), key.alias("citation_key"), evidence.alias("evidence"))


def bib_rows(bibs: DataFrame) -> DataFrame:
    """Bibliographies (project, text), one each, as the audit takes them."""
    f = lambda n: F.try_element_at("fields", F.lit(n))
    table = parsers.bib_table(bibs.select(F.col("project").alias("path"), "text")).withColumnRenamed("path", "project")
    return table.select("project", own("citation_key").alias("citation_key"), f("title").alias("b_title"), f("year").alias("b_year"), f("author").alias("b_author"), f("doi").alias("b_doi"), F.col("raw_text").alias("b_raw"))


def lock_rows(lock: DataFrame) -> DataFrame:
    """Lock entries (project, and an entry's columns) as the audit takes them."""
    return lock.select(
        own("citation_key").alias("citation_key"), "status", F.col("bibtex.source_kind").alias("source_kind"), F.col("authority.bibtex_url").alias("bibtex_url"), F.col("bibtex.normalized_sha256").alias("stored_sha"), F.col("record.title").alias("l_title"), F.col("record.year").alias("l_year"),
        F.get("record.authors", F.lit(0)).alias("l_author"), F.col("record.doi").alias("l_doi"), F.col("record.accessed_at").alias("l_accessed"), F.col("bibtex.fallback_reason").alias("fallback_reason"), F.try_element_at("bibtex.field_checks", F.lit("doi")).alias("doi_check"),
        F.col("authority.source").alias("authority_source"), F.col("authority.record_url").alias("record_url"),
    )


def paper_audit(bibs: DataFrame, lock: DataFrame, tex: DataFrame, roots: DataFrame, claims: DataFrame, source_map: DataFrame | None = None, texts: DataFrame | None = None, title_reviews: DataFrame | None = None, submission: bool = False) -> dict[str, DataFrame]:
    """issues, notes, claims (with what their sources suggest), summary (of issues by code), phases, state and actions' input.

    bibs: project, text; lock: project, ord and entries; tex: project, path, text; roots: project, path; claims: project, ord
    (unique over all), and the columns of a claims table; source_map: project, ord, citation_key, source_text, source_text_raw,
    source_label, evidence_kind; texts: path, text. A claim that another issue stands for isn't told as unchecked besides, and
    of issues alike the first is kept.
    """
    bib = bib_rows(bibs)
    found = audit.bib_lock_result(bib.drop("project"), lock_rows(lock), submission, whole=True)
    parts = [told(found.where("not accepted"), 0, F.col("citation_key"))]
    notes = told(found.where("accepted"), 0, F.col("citation_key"))

    sources, graph = parsers.tex_documents(tex, roots, submission)
    parts.append(told(graph.withColumn("citation_key", F.lit(None).cast("string")), 1, F.col("root")))
    read = tex.join(sources.select("project", "path").distinct(), ["project", "path"], "left_semi")
    cited = parsers.cited_keys(read.select(F.col("project").alias("path"), "text")).select(own("citation_key", "path").alias("citation_key"))
    parts.append(told(audit.cited_and_listed(cited, bib, submission), 2, F.col("citation_key")))

    sug = None
    keyed = claims.withColumn("citation_key", own_list())
    if source_map is not None and texts is not None:
        sm = source_map.withColumn("citation_key", own("citation_key"))
        best = checkpointed(claim_sources.best_sources(keyed, sm, texts))
        sug = best
        new = claim_sources.suggested(claims, best, "Source-map")
        keyed = new.withColumn("citation_key", own_list())
        missing = claim_sources.source_issues(claims.withColumn("citation_key", own_list()), sm, best)
        missing = missing.withColumn("project", F.split_part(F.split_part("citation_key", F.lit(","), F.lit(1)), F.lit(BETWEEN), F.lit(1)))
        parts.append(told(missing.withColumn("evidence", F.when(F.col("claim_id").isNotNull(), F.array("claim_id")).otherwise(F.array().cast("array<string>"))), 4, F.col("citation_key")))
        parts.append(told(audit.consistency_issues(keyed, submission=submission, keep=("project", "claim_id"), whole=True), 5, F.col("claim_id")))
        checked = titles.check(sm, lock.select(own("citation_key").alias("citation_key"), F.col("record.title").alias("title")), texts, None if title_reviews is None else title_reviews.withColumn("citation_key", own("citation_key")))
        parts.append(told(titles.title_issues(checked), 6, F.col("citation_key")))
        claims = new
    parts.append(told(audit.claims(keyed, submission, keep=("project", "claim_id"), whole=True), 3, F.col("claim_id")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # read twice below: issues are short, while making them goes through all texts
    whole = checkpointed(whole)
    # each project's claims are numbered on their own
    claim = F.concat("project", F.lit(BETWEEN), rollup.claim_id_in(F.col("message")))
    stands = whole.where(F.col("code").isin(rollup.CLAIM_REPRESENTATIVES)).select(claim.alias("_claim")).where("_claim is not null").distinct()
    kept = whole.withColumn("_claim", F.when(F.col("code") == "CLAIM_NOT_CHECKED", claim)).join(stands, "_claim", "left_anti").drop("_claim")
    # read several times by what follows
    issues = checkpointed(rollup.first_seen(kept, ["project", "code", "severity", "citation_key", "evidence"], "ord").select(*ISSUE))
    return {"issues": issues, "notes": notes.select(*ISSUE), "claims": claims, "suggestions": sug, "work_items": work_items(lock), "state": state(issues, lock, roots, sug)}


def state(issues: DataFrame, lock: DataFrame, roots: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """One row for each project, as ``actions.audit_actions`` takes it."""
    base = roots.select("project").distinct()
    codes = issues.where("severity = 'blocking'").groupBy("project").agg(F.collect_set("code").alias("blocking"))
    open_ = titles.unverified(lock).groupBy("project").agg(F.count(F.lit(1)).alias("work_items"))
    names = rollup.key_sample(titles.unverified(lock), ["project"]).select("project", F.split("sample", ",").alias("work_keys"))
    missing = rollup.key_sample(issues.where("code = 'SOURCE_TEXT_MISSING_FOR_CITATION'"), ["project"]).select("project", F.split("sample", ",").alias("missing_keys"))
    vain = issues.where("code = 'CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE'").groupBy("project").agg(F.slice(F.array_sort(F.collect_set(F.get("evidence", F.lit(0)))), 1, rollup.SAMPLE).alias("no_match"))
    out = base
    for part in (codes, open_, names, missing, vain):
        out = out.join(part, "project", "left")
    n = F.lit(0).cast("long")
    if suggested is not None:
        made = suggested.groupBy(F.split_part("citation_key", F.lit(BETWEEN), F.lit(1)).alias("project")).agg(F.count(F.lit(1)).alias("updated"))
        out, n = out.join(made, "project", "left"), F.coalesce("updated", F.lit(0))
    none = F.array().cast("array<string>")
    return out.select(
        "project", F.coalesce(F.array_sort("blocking"), none).alias("blocking"), F.coalesce("work_items", F.lit(0)).alias("work_items"), F.coalesce("work_keys", none).alias("work_keys"), F.lit(suggested is not None).alias("checked"),
        F.coalesce("missing_keys", none).alias("missing_keys"), F.coalesce("no_match", none).alias("no_match"), n.alias("updated"), F.lit(False).alias("handed_off"),
    )


def follow_up(audited: dict[str, DataFrame], paths: dict[str, str]) -> DataFrame:
    """The actions of an audit, of each project."""
    return actions.audit_actions(audited["state"], paths)


def gate(issues: DataFrame) -> DataFrame:
    """project, ok: whether nothing blocks."""
    return rollup.ok(issues, "project")


def summaries(issues: DataFrame) -> DataFrame:
    """project, code, severity, n, message, sample, omitted."""
    return rollup.issue_summary(issues, by=("project", "code", "severity"))


def released(audited: dict[str, DataFrame], lock: DataFrame) -> DataFrame:
    """Lock entries of projects that nothing blocks, for handoff."""
    return lock.join(gate(audited["issues"]).where("not ok").select("project"), "project", "left_anti")
