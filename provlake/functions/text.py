"""Text functions as Column expressions. Unicode normal forms, HTML entities and relative addresses are Arrow UDFs."""

from __future__ import annotations

import html
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from provlake.functions.constants import STOP_TERMS, WEAK_EVIDENCE_KINDS


def unicode_form(form: str):
    """An Arrow UDF for a Unicode normal form; texts of ASCII pass as they are."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normal


def unicode_forms(form: str):
    """The same for each text of an array."""

    @F.pandas_udf(ArrayType(StringType()))
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: xs if xs is None else [x if x is None or x.isascii() else unicodedata.normalize(form, x) for x in xs])

    return normal


@F.pandas_udf(ArrayType(StringType()))
def unescaped(s: pd.Series) -> pd.Series:
    """HTML entities of an array's texts as characters."""
    return s.map(lambda xs: xs if xs is None else [x if x is None or "&" not in x else html.unescape(x) for x in xs])


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """An address as it is meant on the page of another."""
    return pd.Series([None if r is None else urljoin(b or "", r) for b, r in zip(base, ref, strict=True)], dtype=object)


#: White space as trimming counts it, one of it, one that is no plain blank, and a line's end.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ODD_BLANK = BLANK.replace(" ", "")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: A citation; its keys are group 1.
CITE = r"\\cite[a-zA-Z*]*\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]+)\}"


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def or_none(c: Column) -> Column:
    """Null instead of an empty text."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*map(or_none, columns), F.lit(None).cast("string"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def single_blanks(c: Column) -> Column:
    """A blank for any white space."""
    return F.regexp_replace(F.regexp_replace(c, ODD_BLANK, " "), " {2,}", " ")


def squeezed(c: Column) -> Column:
    """Stripped, and single blanks for any white space."""
    return F.trim(single_blanks(c))


def lines_of(c: Column) -> Column:
    return F.split(c, LINE_END)


def normalize_title(c: Column, nfkc: bool = True) -> Column:
    """NFKC (unless texts are known to be in it), lower case, TeX escapes, braces, dashes, blanks, quotes, full stop."""
    t = unicode_form("NFKC")(c) if nfkc else c
    t = strip(F.lower(t))
    t = F.regexp_replace(t, r"\\+([&%_$#{}])", "$1")
    t = F.translate(t, "\u2010\u2011\u2013\u2014{}", "----")
    t = single_blanks(t)
    return F.rtrim(F.btrim(t, F.lit("\"'\u201c\u201d\u2018\u2019")), F.lit(".\u3002"))


def normalize_author(c: Column, nfkd: bool = True) -> Column:
    """Base letters and digits in lower case, single blanks."""
    t = unicode_form("NFKD")(c) if nfkd else c
    t = F.regexp_replace(F.lower(t), r"\p{M}+", "")
    t = F.replace(F.replace(t, F.lit("đ"), F.lit("dj")), F.lit("ð"), F.lit("d"))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def same_author(a: Column, b: Column) -> Column:
    """One normalised name holds the other, or both have the same two or more parts."""
    parts = F.array_sort(F.array_distinct(F.split(a, " ")))
    return present(a) & present(b) & (F.contains(a, b) | F.contains(b, a) | ((parts == F.array_sort(F.array_distinct(F.split(b, " ")))) & (F.size(parts) > 1)))


def terms(c: Column) -> Column:
    """Distinct words of four characters or more in lower case, sorted, without citations and stop words."""
    plain = F.regexp_replace(c, CITE, " ")
    # in one text, not by a function for each word: words hold no blanks
    words = F.split(F.lower(F.array_join(F.regexp_extract_all(plain, F.lit("[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0)), " ")), " ")
    return F.sort_array(F.array_except(words, F.array(*map(F.lit, [*STOP_TERMS, ""]))))


def bigrams(t: Column) -> Column:
    """Neighbouring pairs of a sorted term array."""
    n = F.size(t)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))


def evidence_kind(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[- ]", "_")


def is_weak_kind(c: Column) -> Column:
    return evidence_kind(c).isin(WEAK_EVIDENCE_KINDS)


def citation_keys(c: Column) -> Column:
    """Keys of a list that commas, semicolons or blanks divide."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+"), lambda x: x != "")


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 3), rf"{BLANK}+\z", ""), F.lit("..."))).otherwise(c)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical(c: Column) -> Column:
    """A text as its checksum counts it: stripped, with one line end."""
    return F.concat(strip(c), F.lit("\n"))


def cache_key(url: Column) -> Column:
    """A file name for a cached response: what is safe of the address, cut, and a checksum."""
    safe = F.regexp_replace(F.regexp_replace(url, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.substring(safe, 1, 120), F.lit("_"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".json"))


def doi(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.lower(F.trim(F.regexp_replace(t, r"(?i)^doi:\s*", "")))


def pages(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), "[\u2013\u2014]", "-")
    return F.regexp_replace(F.regexp_replace(t, r"\s*--+\s*", "--"), r"(?<!-)\s*-\s*(?!-)", "--")


ARXIV_NUMBER = r"^([A-Za-z.-]+/\d{7}|\d{4}\.\d{4,5})(v\d+)?$"


def arxiv_parts(c: Column) -> tuple[Column, Column]:
    """An arXiv number without prefix and address, and its version; what is no such number stays as it is."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^arxiv:\s*", ""), r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", "")
    t = F.regexp_replace(t, r"\.pdf$", "")
    return F.regexp_replace(t, ARXIV_NUMBER, "$1"), or_none(F.regexp_extract(t, ARXIV_NUMBER, 2))


def arxiv_id(c: Column) -> Column:
    return arxiv_parts(c)[0]


def arxiv_pdf(c: Column) -> Column:
    """The PDF of an arXiv number, whose version stays; null for an empty one."""
    number = F.element_at(F.split(F.regexp_replace(strip(c), "(?i)^arxiv:", ""), "/"), -1)
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number, F.lit(".pdf")))


def shell_quoted(c: Column) -> Column:
    """A word as a shell reads it back."""
    plain = F.regexp_like(c, F.lit(r"^[A-Za-z0-9@%+=:,./_-]+$"))
    return F.when(plain, c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){BLANK}+"), strip), lambda x: x != "")


def host_matches(url: Column, domain: Column) -> Column:
    host = F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))
    return F.coalesce((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)), F.lit(False))
