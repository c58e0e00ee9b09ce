"""Audits: joins and conditions that put out issue rows (code, severity, citation_key, ord, and what else is asked for)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import canonical, citation_keys, is_weak_kind, normalize_author, normalize_title, or_none, present, same_author, sha256, strip, terms

BLOCKING, WARNING = "blocking", "warning"
ISSUE = ["code", "severity", "citation_key", "ord"]


def message(code: Column, detail: Column | None = None) -> Column:
    """What an issue says, with its own detail where its text has a place for one."""
    said = F.create_map(*(F.lit(x) for kv in K.MESSAGES.items() for x in kv))
    text = F.coalesce(F.try_element_at(said, code), F.lit(""))
    return text if detail is None else F.replace(text, F.lit("{}"), F.coalesce(or_none(detail), F.lit("(missing id)")))


def filled(text: str, *details: Column) -> Column:
    """A message with its places filled in turn."""
    parts = text.split("{}")
    return F.concat(*(x for i, part in enumerate(parts) for x in ([F.coalesce(details[i - 1], F.lit(""))] if i else []) + [F.lit(part)]))


class Check(NamedTuple):
    """What makes an issue: when it holds, when it is accepted as it stands, what it shows for it, and what it says."""

    code: str
    severity: str | Column
    holds: Column
    accepted: Column | None = None
    evidence: Column | None = None
    message: Column | None = None


def issues(rows: DataFrame, checks: list[Check], key: Column, first_only: bool = False, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """One issue row for each check that holds, in the checks' order; one pass over rows, no self-unions.

    Where a check may be accepted there is a column ``accepted``; ``whole`` adds message and evidence (an array, in whose
    values issues of one key differ). ``keep`` names columns of rows to carry along.
    """
    notes = any(c.accepted is not None for c in checks)
    more = (["accepted"] if notes else []) + (["message", "evidence"] if whole else [])
    made = []
    for i, c in enumerate(checks):
        severity = c.severity if isinstance(c.severity, Column) else F.lit(c.severity)
        parts = [F.lit(c.code).alias("code"), severity.alias("severity"), F.lit(i).alias("ord")]
        if notes:
            parts.append((F.lit(False) if c.accepted is None else F.coalesce(c.accepted, F.lit(False))).alias("accepted"))
        if whole:
            parts.append((F.lit(K.MESSAGES[c.code]) if c.message is None else c.message).alias("message"))
            parts.append((F.array().cast("array<string>") if c.evidence is None else c.evidence).alias("evidence"))
        made.append(F.when(F.coalesce(c.holds, F.lit(False)), F.struct(*parts)))
    if first_only:
        out = rows.select(*keep, key.alias("citation_key"), F.coalesce(*made).alias("x")).where("x is not null")
    else:
        out = rows.select(*keep, key.alias("citation_key"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return out.select("x.code", "x.severity", "citation_key", "x.ord", *(f"x.{c}" for c in more), *keep)


def bib_lock_result(bib: DataFrame, lock: DataFrame, submission: bool = False, normal: bool = True, whole: bool = False) -> DataFrame:
    """Field by field agreement of bibliography entries with their lock entries; accepted issues are notes.

    bib: citation_key, b_title, b_year, b_author (names that " and " joins), b_doi, b_raw; lock: citation_key, status,
    source_kind, bibtex_url, stored_sha, l_title, l_year, l_author (the first), l_doi, l_accessed, fallback_reason,
    doi_check, and authority_source and record_url, where there are such. A full join on the key; an entry without lock
    gets that issue only. ``normal`` is False where texts are known to be in normal form, so that no Python runs.
    """
    soft = BLOCKING if submission else WARNING
    for c in ("authority_source", "record_url"):
        if c not in lock.columns:
            lock = lock.withColumn(c, F.lit(None).cast("string"))
    j = bib.withColumn("_b", F.lit(True)).join(lock.withColumn("_l", F.lit(True)), "citation_key", "full")
    both = F.col("_b").isNotNull() & F.col("_l").isNotNull()
    kind = F.coalesce("source_kind", F.lit("unknown"))
    official = kind == "official_export"
    no_sha = F.coalesce("stored_sha", F.lit("")).isin("", "placeholder")
    arxiv = kind == "arxiv_manual_normalized"
    there = lambda a, b: both & present(F.col(a).cast("string")) & present(F.col(b).cast("string"))
    title = lambda c: normalize_title(F.coalesce(c, F.lit("")), normal)
    name = lambda c: normalize_author(F.coalesce(c, F.lit("")), normal)
    first = F.get(F.split("b_author", " and "), F.lit(0))
    verified = F.col("status").isin(K.PASSING_LOCK_STATUSES)
    known = kind.isin("official_export", *K.FALLBACK_SOURCE_KINDS)
    low = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    absent = verified & known & low("doi_check").isin(K.DOI_ABSENCE_CHECKS)
    fallback = (F.col("status") == "arxiv_fallback_verified") & (arxiv | (low("authority_source") == "arxiv") | F.contains(low("record_url"), F.lit("arxiv.org")))
    shown = lambda *cs: F.array(*(c.cast("string") for c in cs))
    no_doi = ~present(F.col("l_doi"))
    without_doi = F.when(no_doi, K.MESSAGES_TOLD["DOI_MISSING in the record"]).otherwise(K.MESSAGES_TOLD["DOI_MISSING in the entry"])
    checks = [
        Check("MISSING_LOCK_ENTRY", BLOCKING, F.col("_l").isNull()),
        Check("NON_PASSING_STATUS", BLOCKING, both & ~F.coalesce(verified, F.lit(False)), message=filled(K.MESSAGES["NON_PASSING_STATUS"], F.col("status"))),
        Check("UNVERIFIED_BIBTEX_SOURCE", BLOCKING, both & kind.isin(K.BLOCKED_SOURCE_KINDS), message=filled(K.MESSAGES["UNVERIFIED_BIBTEX_SOURCE"], kind)),
        Check("OFFICIAL_EXPORT_NOT_USED", BLOCKING, both & present(F.col("bibtex_url")) & ~official, evidence=shown(F.col("bibtex_url"))),
        Check("OFFICIAL_EXPORT_CONTENT_CHANGED", soft, both & official & ~no_sha & present(F.col("b_raw")) & (F.col("stored_sha") != sha256(canonical(F.col("b_raw"))))),
        Check("OFFICIAL_EXPORT_CHECKSUM_MISSING", WARNING, both & official & no_sha),
        Check("TITLE_MISMATCH", BLOCKING, there("b_title", "l_title") & (title("b_title") != title("l_title")), evidence=shown(F.col("b_title"), F.col("l_title"))),
        Check("YEAR_MISMATCH", BLOCKING, there("b_year", "l_year") & (F.col("b_year").cast("string") != F.col("l_year").cast("string")), evidence=shown(F.col("b_year"), F.col("l_year"))),
        Check("AUTHOR_MISMATCH", BLOCKING, there("b_author", "l_author") & ~same_author(name("l_author"), name(first)), evidence=shown(first, F.col("l_author"))),
        Check("FALLBACK_REASON_MISSING", soft, both & kind.isin(K.FALLBACK_SOURCE_KINDS) & ~present(F.col("fallback_reason"))),
        Check("ARXIV_ACCESSED_DATE_MISSING", soft, both & arxiv & ~present(F.col("l_accessed"))),
        Check("ARXIV_FALLBACK", WARNING, both & arxiv, fallback),
        Check("DOI_MISSING", WARNING, both & (no_doi | ~present(F.col("b_doi"))), no_doi & absent, F.when(no_doi, F.array().cast("array<string>")).otherwise(shown(F.col("l_doi"))), without_doi),
        Check("LOCK_ENTRY_NOT_IN_BIB", soft, F.col("_b").isNull()),
    ]
    return issues(j, checks, F.col("citation_key"), whole=whole)


def bib_lock(bib: DataFrame, lock: DataFrame, submission: bool = False, normal: bool = True) -> DataFrame:
    """The issues of ``bib_lock_result`` that aren't accepted."""
    return bib_lock_result(bib, lock, submission, normal).where("not accepted").drop("accepted")


def accepted_notes(bib: DataFrame, lock: DataFrame, submission: bool = False, normal: bool = True) -> DataFrame:
    """Provenance that differs from the rule and has been accepted as it is."""
    return bib_lock_result(bib, lock, submission, normal).where("accepted").drop("accepted")


def cited_and_listed(cited: DataFrame, bib: DataFrame, submission: bool = False) -> DataFrame:
    """Keys cited but not listed, and listed but not cited."""
    a, b = cited.select("citation_key").distinct(), bib.select("citation_key").distinct()
    missing = a.join(b, "citation_key", "left_anti").selectExpr("'CITATION_NOT_IN_BIB' code", f"'{BLOCKING}' severity", "citation_key", "0 ord")
    idle = b.join(a, "citation_key", "left_anti").selectExpr("'BIB_ENTRY_NOT_CITED' code", f"'{BLOCKING if submission else WARNING}' severity", "citation_key", "1 ord")
    return missing.unionByName(idle)


def claim_name() -> Column:
    return F.coalesce(or_none(strip(F.col("claim_id"))), F.lit("(missing id)"))


def claims(table: DataFrame, submission: bool = False, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """The claims table's issues, one for each citation key of a claim (or one without key), first failed check only.

    claim_id, citation_key (list), source_location, quote_or_evidence, evidence_kind, status. An empty status counts as
    claim_unchecked; the severity goes by the status as it stands, the pass by its form with underscores.
    """
    soft = BLOCKING if submission else WARNING
    status = F.coalesce(or_none(strip(F.col("status"))), F.lit("claim_unchecked"))
    done = F.replace(status, F.lit("-"), F.lit("_")).isin(K.PASSING_CLAIM_STATUSES)
    hard = F.lit(submission) | status.isin(K.BLOCKING_CLAIM_STATUSES)
    none = lambda c: ~present(strip(F.col(c)))
    kind = strip(F.coalesce("evidence_kind", F.lit("")))
    told = lambda code, *more: filled(K.MESSAGES_TOLD[code], claim_name(), *more) if whole else None
    checks = [
        Check("CLAIM_NOT_CHECKED", F.when(hard, BLOCKING).otherwise(WARNING), ~done, message=told("CLAIM_NOT_CHECKED", status)),
        Check("CLAIM_SOURCE_LOCATION_MISSING", soft, none("source_location"), message=filled(K.MESSAGES["CLAIM_SOURCE_LOCATION_MISSING"], claim_name())),
        Check("CLAIM_EVIDENCE_MISSING", soft, none("quote_or_evidence"), message=told("CLAIM_EVIDENCE_MISSING")),
        Check("CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE", BLOCKING, is_weak_kind(F.col("evidence_kind")), evidence=F.array(kind), message=told("CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE", kind)),
    ]
    rows = table.withColumn("_key", F.explode_outer(citation_keys(F.col("citation_key"))))
    return issues(rows, checks, F.col("_key"), first_only=True, keep=keep, whole=whole)


def claims_schema(columns: list[str]) -> list[str]:
    """Required columns that a claims table lacks; if any, CLAIM_TABLE_SCHEMA_INVALID is its only issue."""
    return sorted({"claim_id", "citation_key", "source_location", "status"} - set(columns))


def reviewed(table: DataFrame, min_overlap: int = 2, submission: bool = False) -> DataFrame:
    """Claims against their quotes: table with overlap, shared, ok and the conditions that issues are made of."""
    t = table.withColumns({"_c": terms(F.coalesce("claim_text", F.lit(""))), "_e": terms(F.coalesce(strip(F.col("quote_or_evidence")), F.lit("")))})
    t = t.withColumns({"shared": F.array_sort(F.array_intersect("_c", "_e"))})
    status = F.coalesce(or_none(strip(F.col("status"))), F.lit("claim_unchecked"))
    words = lambda xs: F.array(*map(F.lit, xs))
    t = t.withColumns(
        {
            "overlap": F.size("shared").cast("long"),
            "_done": status.isin(*K.PASSING_CLAIM_STATUSES, "checked-arxiv"),
            "_quote": present(strip(F.col("quote_or_evidence"))),
            "_strong": F.array_sort(F.array_intersect("_c", words(K.STRONG_TERMS))),
            "_hedged": F.arrays_overlap("_e", words(K.HEDGE_TERMS)),
        }
    )
    enough = F.col("overlap") >= min_overlap
    return t.withColumns({"_enough": enough, "ok": F.col("_quote") & enough & (F.col("_done") | F.lit(not submission))})


def _consistency_checks(min_overlap: int, submission: bool) -> list[Check]:
    soft = BLOCKING if submission else WARNING
    quote, enough, done = F.col("_quote"), F.col("_enough"), F.col("_done")
    final = F.lit(submission) & quote & enough
    kind = strip(F.coalesce("evidence_kind", F.lit("")))
    told = lambda code: filled(K.MESSAGES[code], claim_name())
    return [
        Check("CLAIM_EVIDENCE_MISSING", soft, ~quote, message=told("CLAIM_EVIDENCE_MISSING")),
        Check("CLAIM_EVIDENCE_LOW_OVERLAP", soft, quote & ~enough, evidence=F.col("shared"), message=told("CLAIM_EVIDENCE_LOW_OVERLAP")),
        Check("CLAIM_MAY_BE_TOO_STRONG", soft, (F.size("_strong") > 0) & quote & ((F.col("overlap") < min_overlap + 1) | F.col("_hedged")), evidence=F.col("_strong"), message=told("CLAIM_MAY_BE_TOO_STRONG")),
        Check("CLAIM_STATUS_NOT_FINAL", BLOCKING, final & ~done, message=told("CLAIM_STATUS_NOT_FINAL")),
        Check("CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE", BLOCKING, final & done & is_weak_kind(F.col("evidence_kind")), evidence=F.array(kind), message=filled(K.MESSAGES_TOLD["CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE"], claim_name(), kind)),
    ]


def consistency_issues(table: DataFrame, min_overlap: int = 2, submission: bool = False, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """All issues of claims against their quotes, in order; a claim may have several. citation_key is the whole list."""
    return issues(reviewed(table, min_overlap, submission), _consistency_checks(min_overlap, submission), or_none(strip(F.col("citation_key"))), keep=keep, whole=whole)


def consistency_summary(table: DataFrame, min_overlap: int = 2, submission: bool = False) -> DataFrame:
    """result_count, ok_count, blocking_issue_count, warning_count of a claims table, in one pass."""
    of = lambda severity: F.coalesce(F.sum(sum((F.when(c, 1).otherwise(0) for _, s, c, *_ in _consistency_checks(min_overlap, submission) if s == severity), F.lit(0))), F.lit(0)).cast("long")
    t = reviewed(table, min_overlap, submission)
    return t.agg(F.count(F.lit(1)).alias("result_count"), F.count_if("ok").alias("ok_count"), of(BLOCKING).alias("blocking_issue_count"), of(WARNING).alias("warning_count"))


def consistency(table: DataFrame, min_overlap: int = 2, submission: bool = False) -> DataFrame:
    """Claims with their overlap and first issue (null if none): claim_id, overlap, issue, severity."""
    checks = _consistency_checks(min_overlap, submission)
    issue, severity = (F.coalesce(*(F.when(c[2], F.lit(c[i])) for c in checks)) for i in (0, 1))
    return reviewed(table, min_overlap, submission).select("claim_id", "overlap", issue.alias("issue"), severity.alias("severity"))
