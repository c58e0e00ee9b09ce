"""Roll-ups of issues and actions, first-seen selection and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.functions.constants import CLAIM_REPRESENTATIVES, CLAIMS_SAY, PHASE_PREFIXES, PHASES

SAMPLE = 10


def key_sample(rows: DataFrame, by: list[str], sample: int = SAMPLE, order: str | None = None) -> DataFrame:
    """By the columns: sample (the first distinct citation keys, joined) and omitted (how many more there are).

    Keys are made distinct before they are ranked, and ranked keys beyond the sample are dropped before they are
    joined, so no group's keys are ever held together. Keys are in the order of ``order``, or their own.
    """
    seen = F.min(order) if order else F.min("citation_key")
    keys = rows.where("citation_key is not null").groupBy(*by, "citation_key").agg(seen.alias("_first"))
    n_keys = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"))
    top = keys.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("_first", "citation_key"))).where(F.col("r") <= sample)
    names = top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "citation_key"))), lambda x: x["citation_key"].cast("string")), ",").alias("sample"))
    return n_keys.join(names, by).select(*by, "sample", F.greatest(F.col("n_keys") - sample, F.lit(0)).alias("omitted"))


def issue_summary(issues: DataFrame, sample: int = SAMPLE, by: tuple[str, ...] = ("code", "severity")) -> DataFrame:
    """By code and severity: n, message (the first, if issues have one), and the sample of keys."""
    by = list(by)
    first = [F.min_by("message", "ord").alias("message")] if "message" in issues.columns else []
    counts = issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *first)
    out = counts.join(key_sample(issues, by, sample), by, "left")
    return out.select(*by, "n", *(["message"] if first else []), F.coalesce("sample", F.lit("")).alias("sample"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


def said_of_all(code: Column, message: Column) -> Column:
    """What is said of all issues of a code: of claims in general, of others as their own message has it."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CLAIMS_SAY.items() for x in kv)), code), message)


def issue_groups(issues: DataFrame, sample: int = 5) -> DataFrame:
    """code, message, n, sample, omitted: issues counted by what is said of all of them."""
    rows = issues.withColumn("message", said_of_all(F.col("code"), F.col("message")))
    counts = rows.groupBy("code", "message").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    out = counts.join(key_sample(rows, ["code", "message"], sample, "ord"), ["code", "message"], "left")
    return out.select("code", "message", "n", F.coalesce("sample", F.lit("")).alias("sample"), F.coalesce("omitted", F.lit(0)).alias("omitted"), "ord")


def phase_of(code: Column) -> Column:
    out = F.lit(PHASES[0])
    for prefix, phase in reversed(PHASE_PREFIXES):
        out = F.when(F.startswith(code, F.lit(prefix)), phase).otherwise(out)
    return out


def phases(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """One row for each of the four phases, those without issues too: blocking, warnings, codes, status."""
    all_ = spark.createDataFrame([(i, p) for i, p in enumerate(PHASES)], "ord int, phase string")
    agg = issues.withColumn("phase", phase_of(F.col("code"))).groupBy("phase").agg(
        F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("code").alias("codes")
    )
    j = F.broadcast(all_).join(agg, "phase", "left").fillna(0, ["blocking", "warnings", "codes"])
    return j.select("phase", "blocking", "warnings", "codes", F.when(F.col("blocking") > 0, "blocked").otherwise("passed").alias("status"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Of issues alike in code, severity, key and evidence the first."""
    return first_seen(issues, ["code", "severity", "citation_key", "evidence"], "ord")


def claim_id_in(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"\bclaim[-_]\d+\b", 0), F.lit(""))


def without_redundant(issues: DataFrame) -> DataFrame:
    """Issues but CLAIM_NOT_CHECKED of claims that another issue stands for; by the claim's number in the message."""
    own = claim_id_in(F.col("message"))
    told = issues.where(F.col("code").isin(CLAIM_REPRESENTATIVES)).select(own.alias("_claim")).where("_claim is not null").distinct()
    marked = issues.withColumn("_claim", F.when(F.col("code") == "CLAIM_NOT_CHECKED", own))
    return marked.join(told, "_claim", "left_anti").drop("_claim")


def first_of_group(rows: DataFrame, by: str, order: str, wanted: Column) -> DataFrame:
    """Of each group the first row that is wanted, by one aggregate."""
    cols = [c for c in rows.columns if c != by]
    return rows.where(wanted).groupBy(by).agg(F.min_by(F.struct(*cols), order).alias("_x")).select(by, "_x.*")


def gated(rows: DataFrame, by: str, order: str, wanted: Column, most: int) -> DataFrame:
    """Adds selected: the first ``most`` wanted rows of each ``by``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(wanted, 1).otherwise(0)).over(w)
    return rows.withColumn("selected", wanted & (n <= most))


def ok(issues: DataFrame, by: str) -> DataFrame:
    """Whether a group has no blocking issue."""
    return issues.groupBy(by).agg((~F.bool_or(F.col("severity") == "blocking")).alias("ok"))


def failure_summary(results: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """code, source, n, message, sample, omitted of lookups that failed. results: ord, source, ok, error, citation_key."""
    from provlake.operators.titles import failure_code, failure_message

    rows = results.where("not ok").withColumn("code", failure_code(F.col("error")))
    out = rows.groupBy("code", "source").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).join(key_sample(rows, ["code", "source"], sample, "ord"), ["code", "source"], "left")
    return out.select("code", "source", "n", "first", failure_message(F.col("code"), F.col("source")).alias("message"), F.coalesce("sample", F.lit("")).alias("sample"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


def suite_counts(items: DataFrame, most: int | None = None) -> DataFrame:
    """source (or mixed), queries, run, skipped, ok_count, all_ok of a list of lookups. items: ord, source, ok."""
    ran = F.lit(True) if most is None else F.col("ord") < most
    good = F.coalesce(F.col("ok"), F.lit(False))
    return items.agg(
        F.when(F.count_distinct("source") == 1, F.max("source")).otherwise("mixed").alias("source"), F.count(F.lit(1)).alias("queries"), F.count_if(ran).alias("run"), F.count_if(~ran).alias("skipped"), F.count_if(ran & good).alias("ok_count"),
        (F.count_if(ran) > 0).alias("_any"), F.count_if(ran & ~good).alias("_bad"),
    ).select("source", "queries", "run", "skipped", "ok_count", (F.col("_any") & (F.col("_bad") == 0)).alias("all_ok"))


def source_counts(items: DataFrame, most: int | None = None) -> DataFrame:
    """source, queries, run of a list of lookups."""
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.lit(True) if most is None else F.col("ord") < most).alias("run"))
