"""Fill-in-middle texts by escaped marker injection, in DataFrame functions only.

A delimiter is escaped in the text and then appended after each unit by one ``regexp_replace``; counting it gives the
number of units, ``substring_index`` cuts at a unit by its rank, and the pieces are unescaped and assembled. So no text is
exploded or leaves its row, nothing is shuffled, and a text's cost is proportional to its length.

Units are ``[A-Za-z]+`` or one other code point. The escape sign and the delimiter are control characters; where a text
holds them, they become the escape sign with a digit, which is one unit as the character was.

Edge cases: null text counts as empty, empty text is plain; a text that holds a sentinel is plain, since its output
couldn't be taken apart; a null doc_id hashes as the empty string; repeated rows are kept, each with its own result; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE, DELIMITER = "\x01", "\x02"
UNIT = "[A-Za-z]++|\x01[01]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are transformed, and so many of these have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """text, escaped, with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER)


def count_units(text: Column) -> Column:
    """Units of a marked text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(DELIMITER), F.lit("")))).cast("long")


def first_units(text: str, k: str) -> Column:
    """The first k units of a marked text, still marked but for the last delimiter."""
    return F.expr(f"substring_index({text}, '\\u0002', cast({k} as int))")


def last_units(text: str, k: str) -> Column:
    """What follows the k-th delimiter from the end."""
    return F.expr(f"substring_index({text}, '\\u0002', -cast({k} as int))")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of its hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output of every row of docs."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = rows.select("doc_id", "text", marked(F.col("text")).alias("_m"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    rows = rows.withColumn("n", count_units(F.col("_m")))
    sentinel = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | sentinel | (F.col("_h3") % 100 >= transformed)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", "form", "_m", F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
    rows = rows.select("doc_id", "text", "n", "form", "_lo", "_hi", first_units("_m", "_hi").alias("_head"), F.when(F.col("_hi") < F.col("n"), last_units("_m", "n - _hi + 1")).otherwise("").alias("_tail"))
    cut = F.col("form") != "plain"
    rows = rows.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(cut, unescaped(first_units("_head", "_lo"))).alias("prefix"),
        # the head ends without its delimiter, so its last k units take k
        F.when(cut, unescaped(F.when(F.col("_lo") < F.col("_hi"), last_units("_head", "_hi - _lo")).otherwise(""))).alias("middle"),
        F.when(cut, unescaped(F.col("_tail"))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone; no piece holds a sentinel, so each is found by its first occurrence."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    between = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = F.substr(body, F.length(one) + F.length(between) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs."""
    made = transform(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: digests() for DuckDB: the units as a list, its slices joined.
SQL = r"""
with rows as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as digest,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
  from documents
), drawn as (
  select doc_id, text, units, cast(len(units) as bigint) as n,
         cast('0x' || substr(digest, 1, 8) as bigint) as h1, cast('0x' || substr(digest, 9, 8) as bigint) as h2,
         cast('0x' || substr(digest, 17, 8) as bigint) as h3, cast('0x' || substr(digest, 25, 8) as bigint) as h4
  from rows
), placed as (
  select doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), cut as (
  select doc_id, text, n, form,
         array_to_string(units[1:lo], '') as prefix, array_to_string(units[lo + 1:hi], '') as middle, array_to_string(units[hi + 1:n], '') as suffix
  from placed
)
select doc_id, n, form,
       case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from cut
"""
