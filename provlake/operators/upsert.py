"""Keyed updates and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import canonical, evidence_kind, is_weak_kind, or_none, present, sha256, strip


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new's keys replaced whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


#: Entries of these kinds may replace what a bibliography has.
SYNCABLE = ["official_export", *K.FALLBACK_SOURCE_KINDS]


def sync_action(bib: DataFrame, lock: DataFrame, wanted: DataFrame | None = None, add_missing: bool = True) -> DataFrame:
    """bib: citation_key, text; lock: citation_key, status, source_kind, canonical, stored_sha -> citation_key, action, reason, text, source_kind.

    action is blocked, add, unchanged, replace or skipped; text is what is put in place (null: what is there stays).
    ``wanted`` (citation_key) names the entries that were asked for, those that neither table has too; without it, lock
    entries that the bibliography lacks count only if they are to be added.
    """
    j = bib.join(lock, "citation_key", "full") if wanted is None else bib.join(lock, "citation_key", "full").join(wanted.select("citation_key", F.lit(True).alias("_w")).distinct(), "citation_key", "full")
    asked = F.lit(True) if wanted is None else F.coalesce("_w", F.lit(False))
    there, known = F.col("text").isNotNull(), F.col("status").isNotNull()
    stored = F.coalesce("stored_sha", F.lit(""))
    want = sha256(canonical(F.col("canonical")))
    reason = (
        F.when(there & ~asked, "not_requested")
        .when(there & ~known, "missing_lock_entry")
        .when(~known, "lock_entry_missing")
        .when(~F.col("status").isin(K.PASSING_LOCK_STATUSES), "non_passing_status")
        .when(~F.coalesce("source_kind", F.lit("unknown")).isin(SYNCABLE), "unsyncable_source_kind")
        .when(~present(strip(F.col("canonical"))), "canonical_bibtex_text_missing")
        .when(~stored.isin("", "placeholder") & (stored != want), "canonical_checksum_mismatch")
        .when(~there, "missing_from_bib" if add_missing else "missing_from_bib_add_missing_disabled")
        .when(sha256(canonical(F.col("text"))) == want, "already_synced")
        .otherwise("current_bibtex_differs_from_lock_canonical")
    )
    actions = {"not_requested": "skipped", "missing_lock_entry": "skipped", "missing_from_bib": "add", "missing_from_bib_add_missing_disabled": "skipped", "already_synced": "unchanged", "current_bibtex_differs_from_lock_canonical": "replace"}
    of = F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))
    out = j.withColumn("reason", reason).withColumn("action", F.coalesce(F.try_element_at(of, F.col("reason")), F.lit("blocked")))
    if wanted is not None:
        out = out.where(there | asked)
    elif not add_missing:
        out = out.where(there)
    new = F.when(F.col("action").isin("add", "replace"), canonical(F.col("canonical")))
    return out.select("citation_key", "action", "reason", new.alias("text"), "source_kind")


def sync_issues(actions: DataFrame) -> DataFrame:
    """code, severity, citation_key of actions that are blocked, or that leave an entry as it is for want of another."""
    code = F.when(F.col("action") == "blocked", F.upper("reason")).when(F.col("reason") == "missing_lock_entry", "BIB_ENTRY_NOT_IN_LOCK").when(F.col("reason") == "missing_from_bib_add_missing_disabled", "BIB_ENTRY_MISSING")
    return actions.select(code.alias("code"), F.when(F.col("action") == "blocked", "blocking").otherwise("warning").alias("severity"), "citation_key").where("code is not null")


def synced_text(spans: DataFrame, actions: DataFrame) -> DataFrame:
    """path, text, ok, changes: whole bibliographies with their actions done, nothing of one with a blocked entry.

    spans: path, ord, citation_key (null where a span has none), text, preface (what stands before the first, on each
    row); actions: path, citation_key, action, text. Entries keep their order, new ones follow by key.
    """
    own = actions.select("path", "citation_key", "action", F.col("text").alias("_new"))
    kept = spans.join(own, ["path", "citation_key"], "left").select("path", F.lit(0).alias("_late"), F.col("ord").cast("long").alias("ord"), F.lit("").alias("_key"), F.coalesce("_new", "text").alias("body"), "action", "preface")
    added = own.where("action = 'add'").select("path", F.lit(1).alias("_late"), F.lit(0).cast("long").alias("ord"), F.col("citation_key").alias("_key"), F.col("_new").alias("body"), "action", F.lit(None).cast("string").alias("preface"))
    blocked = own.groupBy("path").agg((~F.bool_or(F.col("action") == "blocked")).alias("ok"), F.count_if(F.col("action").isin("add", "replace")).alias("changes"))
    # one bibliography's entries, as one file holds them
    whole = kept.unionByName(added).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_late", "ord", "_key", "body"))).alias("x"), F.max("preface").alias("preface"))
    blocks = F.filter(F.concat(F.array(F.coalesce(strip(F.col("preface")), F.lit(""))), F.transform("x", lambda e: strip(e["body"]))), lambda b: b != "")
    text = F.when(F.size(blocks) > 0, F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))).otherwise("")
    return whole.select("path", text.alias("text")).join(blocked, "path", "left").select("path", "text", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("changes", F.lit(0)).alias("changes"))


def manifest_diff(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """What is expected but missing, or there with another checksum; more than expected doesn't matter."""
    j = expected.withColumnRenamed("sha", "_want").join(actual.select(*keys, F.col("sha").alias("_have")), keys, "left")
    state = F.when(F.col("_have").isNull(), "missing").when(present(F.col("_want")) & (F.col("_want") != F.col("_have")), "changed")
    return j.select(*keys, state.alias("state")).where("state is not null")


def decided_status(decision: Column, kind: Column, allow_checked: bool = False) -> Column:
    weak = is_weak_kind(kind)
    d = F.lower(strip(decision))
    review = F.when(weak, "needs_review_weak_evidence").otherwise("needs_review")
    return (
        F.when(d.isin("supported", "checked") & F.lit(allow_checked) & ~weak, "checked")
        .when(d.isin("supported", "checked", "needs_review"), review)
        .when(d.isin("too_strong", "wrong_source"), d)
        .when(d.isin("delete_or_rewrite", "unsupported"), "delete_or_rewrite")
        .when(d == "no_evidence", "claim_unchecked")
        .otherwise("needs_review")
    )


def import_reviews(claims: DataFrame, reviews: DataFrame, allow_checked: bool = False) -> DataFrame:
    """Claims with the status of their last review; reviews of unknown claims are for the caller to reject first."""
    last = last_wins(reviews, "claim_id", "ord").select("claim_id", "decision", F.col("evidence_kind").alias("_kind"))
    j = claims.join(last, "claim_id", "left")
    status = F.when(F.col("decision").isNull(), F.col("status")).otherwise(decided_status(F.col("decision"), F.coalesce("_kind", "evidence_kind"), allow_checked))
    return j.withColumn("status", status).select(*claims.columns)


def unknown_reviews(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    return reviews.join(claims.select("claim_id"), "claim_id", "left_anti")


def review_issues(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """code, claim_id, ord of reviews that can't be applied; any of them, and none is."""
    known = claims.where(present(F.col("claim_id"))).select(F.col("claim_id").alias("_id"), F.lit(True).alias("_known")).distinct()
    id_ = strip(F.coalesce("claim_id", F.lit("")))
    j = reviews.withColumn("_id", id_).join(known, "_id", "left")
    code = (
        F.when(F.col("_id") == "", "REVIEW_CLAIM_ID_MISSING")
        .when(F.col("_known").isNull(), "REVIEW_CLAIM_UNKNOWN")
        .when(~F.lower(strip(F.coalesce("decision", F.lit("")))).isin(K.REVIEW_DECISIONS), "REVIEW_DECISION_UNSUPPORTED")
    )
    return j.select(code.alias("code"), F.col("_id").alias("claim_id"), "ord").where("code is not null")


def apply_reviews(claims: DataFrame, reviews: DataFrame, allow_checked: bool = False) -> DataFrame:
    """Claims with all that their reviews say, one after the other: place, quote, kind, status and notes.

    claims need ord; of rows with one claim_id the last is changed. With any row in ``review_issues`` claims stay as they are.
    """
    fields = ["decision", "source_location", "quote_or_evidence", "evidence_kind", "review_notes", "notes", "suggested_rewrite"]
    for f in fields:
        if f not in reviews.columns:
            reviews = reviews.withColumn(f, F.lit(None).cast("string"))
    told = lambda c: or_none(strip(F.coalesce(c, F.lit(""))))
    bad = review_issues(claims, reviews).agg(F.count(F.lit(1)).alias("_bad"), F.lit(1).alias("_one"))
    # the reviews of one claim, in order
    said = reviews.groupBy(strip(F.coalesce("claim_id", F.lit(""))).alias("claim_id")).agg(F.array_sort(F.collect_list(F.struct("ord", *(told(F.col(f)).alias(f) for f in fields)))).alias("_said"))
    last = claims.groupBy("claim_id").agg(F.max("ord").alias("ord"), F.lit(True).alias("_last"))
    j = claims.join(last, ["claim_id", "ord"], "left").join(said, "claim_id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(bad), "_one", "left")  # one row
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    start = F.struct(text("source_location"), text("quote_or_evidence"), text("evidence_kind"), text("status"), text("notes"))

    def step(acc: Column, r: Column) -> Column:
        kind = evidence_kind(F.coalesce(r["evidence_kind"], or_none(acc["evidence_kind"]), F.lit("source_text")))
        decision = F.lower(r["decision"])
        own = F.coalesce(r["review_notes"], r["notes"])
        note = F.concat(
            F.lit("Review decision: "), decision, F.lit("."),
            F.coalesce(F.concat(F.lit(" Review notes: "), own), F.lit("")), F.coalesce(F.concat(F.lit(" Suggested rewrite: "), r["suggested_rewrite"]), F.lit("")),
        )
        before = strip(acc["notes"])
        return F.struct(
            F.coalesce(r["source_location"], acc["source_location"]).alias("source_location"),
            F.coalesce(r["quote_or_evidence"], acc["quote_or_evidence"]).alias("quote_or_evidence"),
            kind.alias("evidence_kind"),
            decided_status(decision, kind, allow_checked).alias("status"),
            F.when(before == "", note).otherwise(F.concat(before, F.lit(" "), note)).alias("notes"),
        )

    done = F.aggregate("_said", start, step)
    apply = F.col("_last") & F.col("_said").isNotNull() & (F.col("_bad") == 0) & (F.col("claim_id") != "")
    j = j.withColumn("_new", F.when(F.coalesce(apply, F.lit(False)), done))
    changed = ["source_location", "quote_or_evidence", "evidence_kind", "status", "notes"]
    return j.select(*(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in claims.columns))
