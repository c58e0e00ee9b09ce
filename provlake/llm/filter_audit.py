"""Filter interaction audit: how five document filters overlap, in every order, for each part of the corpus.

A relational word pipeline. Words are exploded, counted by (document, word) and then by document, which gives totals and
distinct words without a set in any row. The other flags are outer-joined: capitals and signs by expressions, copies by the
least doc_id of each text, labels by doc_id. Each document's failures are five bits, so a part's whole answer lies in 32
conditional counts; all 120 orders and their steps are arithmetic on these, made after the data is down to a row a part.

Scale. Texts are dealt once by (document, partition read), after which both word aggregations need no further shuffle: a
word never travels alone. A document is (doc_id, 64-bit hash of its text), so that rows with one doc_id and unlike texts stay
apart; between documents, texts are compared by SHA-256. Copies aren't joined to their groups: documents are counted by (text, doc_id, part,
labels), then by (text, part, labels) with the least doc_id and its count kept apart, so a text that a third of all rows
share is one row per part before any window sees it. All sums have a map-side half; nothing is broadcast but by size.

Edge cases: null text counts as empty, a null part as the empty string. Rows with a null doc_id have no label, are no
copies and make none (no id is smaller than theirs). Repeated rows count as often as they stand there; they don't make each
other copies, as neither has a smaller doc_id. Repeated labels of a document count once, 1 before 0; null labels are none.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm.common import input_bytes

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of words
MOST_CAPITALS = 2  # per cent of code points
SIGNS = "[#$%&*|]"
BLANKS = "[\\x20\\x09-\\x0D]+"
PART_BYTES, MOST_BYTES, MANY = 2_000_000, 64_000_000, 50_000
PATTERNS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_counts(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, row_hash, n_words and n_distinct of every (doc_id, row_hash) in rows (doc_id, row_hash, text).

    An empty word stands for the row itself, once a row: its count says how many rows alike were counted together, and
    keeps documents without words.
    """
    dealt = rows.withColumn("place", F.spark_partition_id()).repartition(n, "doc_id", "row_hash", "place")
    # the outer form, as the inner one has a filter inferred for it, which splits the text a second time
    words = dealt.select("doc_id", "row_hash", "place", F.explode_outer(F.array_append(F.array_remove(F.split("text", BLANKS), ""), "")).alias("word"))
    by_word = words.groupBy("doc_id", "row_hash", "place", "word").agg(F.count(F.lit(1)).alias("n"))
    by_place = by_word.groupBy("doc_id", "row_hash", "place").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("alike"))
    counted = by_place.select("doc_id", "row_hash", F.expr("total div alike - 1").alias("n_words"), (F.col("kinds") - 1).alias("n_distinct"))
    # many small maps of little more than a row a document: to as many targets they would write mostly empty files
    return counted.repartition(max(1, n // 16), "doc_id", "row_hash").groupBy("doc_id", "row_hash").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def partitions(docs: DataFrame) -> int:
    """As many as the session asks for, or more: ``PART_BYTES`` of stored input each, or ``MOST_BYTES`` beyond ``MANY``.

    The number is given, so that small partitions aren't put together again: maps of words that fit the cache are built
    in little more than half the time. Larger ones spill.
    """
    asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = input_bytes(docs) or 0
    return max(1, asked, min(size // PART_BYTES, max(MANY, size // MOST_BYTES)))


def label_flags(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask (bit i set: fails filter i), good, toxic, n: documents, counted by what they fail, within each text.

    Rows are of one text, part, mask and pair of labels; texts aren't named in the result, as only sums are taken of it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    plain = wide.select("doc_id", "row_hash", F.unhex(F.sha2("text", 256)).alias("hash"), "part", (100 * upper.cast("long") > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(SIGNS).alias("d"))
    plain = plain.groupBy("doc_id", "row_hash", "hash", "part", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    counted = word_counts(wide.select("doc_id", "row_hash", "text"), partitions(docs))
    counted = counted.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "n_words", "n_distinct")
    rows = plain.join(counted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    rows = rows.join(label_flags(labels), "doc_id", "left")
    a = F.coalesce("n_words", F.lit(0)) < LEAST_WORDS
    b = 100 * F.coalesce("n_distinct", F.lit(0)) < LEAST_DISTINCT * F.coalesce("n_words", F.lit(0))
    bits = [F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate((a, b, F.col("c"), F.col("d")))]
    rows = rows.select("hash", "doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    # of each text: the least doc_id of a part, with its own count, so that only that one can be the first
    by_part = rows.groupBy("hash", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = F.min("least.doc_id").over(Window.partitionBy("hash"))
    by_part = by_part.withColumn("first", first)
    # rows of the first document, and those without an id, are no copies
    kept = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - kept).alias("n")))
    return by_part.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def patterns(found: DataFrame) -> DataFrame:
    """part, and arrays of 32: documents by the filters they fail, of all, of good and of toxic ones."""

    def counts(name: str, flag: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(flag & (F.col("mask") == p), F.col("n"))), F.lit(0)) for p in range(PATTERNS)]).alias(name)

    return found.groupBy("part").agg(counts("documents", F.lit(True)), counts("good", F.col("good") == 1), counts("toxic", F.col("toxic") == 1))


def steps() -> Column:
    """All orders and their steps: the order, the step, the bits of the filters before it, its own bit."""
    out = []
    for order in ORDERS:
        for i, name in enumerate(order):
            before = sum(1 << FILTERS.index(x) for x in order[:i])
            out.append((order, i + 1, before, 1 << FILTERS.index(name)))
    table = ", ".join(f"struct('{o}' as filter_order, {s} as step, {b} as before, {own} as own)" for o, s, b, own in out)
    return F.expr(f"array({table})")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every order of the five filters, at every step, for each part. ``shapley`` is what the step's filter removes, summed
    over all orders: in 120 orders a document that fails k filters is removed by each of them 120 / k times.
    """
    counts = patterns(failures(docs, labels, part)).select("part", F.posexplode(F.arrays_zip("documents", "good", "toxic")).alias("p", "x"))
    rows = counts.select("part", "p", "x.*", F.explode(steps()).alias("s")).select("part", "p", "documents", "good", "toxic", "s.*")
    gone, failing = F.col("p").bitwiseAND(F.col("before")) > 0, F.col("p").bitwiseAND(F.col("own")) > 0

    def total(which: Column, counts: Column | str = "documents") -> Column:
        return F.sum(F.when(which, counts if isinstance(counts, Column) else F.col(counts)).otherwise(F.lit(0)))

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~failing).alias("kept"),
        total(~gone & failing).alias("removed"),
        total(gone & failing).alias("redundant"),
        total(F.col("p") == F.col("own")).alias("unique_fails"),
        total(~gone & failing, "good").alias("good_lost"),
        total(~gone & failing, "toxic").alias("toxic_lost"),
        total(failing, F.expr(f"documents * ({len(ORDERS)} div bit_count(p))")).alias("shapley"),
    )


#: audit() for DuckDB, by following each document through each order.
SQL = r"""
with rows as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
), firsts as (
  select text, min(doc_id) as first_id from rows group by text
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
), flagged as (
  select r.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
         case when len(r.words) < 200 then 'A' else '' end
         || case when 100 * len(list_distinct(r.words)) < 50 * len(r.words) then 'B' else '' end
         || case when 100 * length(regexp_replace(r.text, '[^A-Z]', '', 'g')) > 2 * length(r.text) then 'C' else '' end
         || case when regexp_matches(r.text, '[#$%&*|]') then 'D' else '' end
         || case when r.doc_id > f.first_id then 'E' else '' end as fails
  from rows r join firsts f on r.text = f.text left join marks m on r.doc_id = m.doc_id
), documents_of as (
  select part, fails, good, toxic, count(*) as n from flagged group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x
), followed as (
  select o.filter_order, s.step, d.part, d.n, d.good, d.toxic, d.fails, substr(o.filter_order, s.step, 1) as letter,
         contains(d.fails, substr(o.filter_order, s.step, 1)) as failing,
         length(replace(translate(d.fails, substr(o.filter_order, 1, s.step - 1), ''), ' ', '')) < length(d.fails) as gone
  from documents_of d, orders o, (select unnest([1, 2, 3, 4, 5]) as step) s
), counted as (
  select part, filter_order, cast(step as integer) as step, letter,
         cast(sum(case when not gone and not failing then n else 0 end) as bigint) as kept,
         cast(sum(case when not gone and failing then n else 0 end) as bigint) as removed,
         cast(sum(case when gone and failing then n else 0 end) as bigint) as redundant,
         cast(sum(case when fails = letter then n else 0 end) as bigint) as unique_fails,
         cast(sum(case when not gone and failing then n * good else 0 end) as bigint) as good_lost,
         cast(sum(case when not gone and failing then n * toxic else 0 end) as bigint) as toxic_lost
  from followed group by part, filter_order, step, letter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from counted
"""
