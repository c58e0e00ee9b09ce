"""Lock entries: queries of them, entries from bibliographies and decisions, handoff items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import canonical, first_present, or_none, present, sha256, strip
from provlake.operators.titles import unverified
from provlake.operators.upsert import last_wins, upsert
from provlake.sources.parsers import recommended_sources, rekeyed


def short_title(title: Column) -> Column:
    """What stands before the first colon, or the first 40 characters."""
    return first_present(strip(F.get(F.split(title, ":"), F.lit(0))), strip(F.substring(title, 1, 40)))


def by_key(lock: DataFrame) -> DataFrame:
    """One entry for each key, the last."""
    return last_wins(lock, "citation_key", "ord") if "ord" in lock.columns else lock


def query_columns() -> list[Column]:
    r = lambda f: F.col(f"record.{f}")
    authors = F.filter(F.transform(F.coalesce(r("authors"), F.array().cast("array<string>")), strip), present)
    year = F.when(F.regexp_like(r("year"), F.lit(r"^\d+$")), r("year").try_cast("int"))
    return [
        F.col("citation_key").alias("query_id"), F.col("citation_key"), strip(first_present(r("title"), F.col("short_title"), F.col("citation_key"))).alias("title"), authors.alias("authors"), year.alias("year"),
        or_none(r("doi")).alias("doi"), or_none(r("arxiv_id")).alias("arxiv_id"), F.filter(F.array(or_none(r("venue")), or_none(r("url"))), lambda x: x.isNotNull()).alias("preferred_venues"),
    ]


def query_of(lock: DataFrame) -> DataFrame:
    """The lookup that an entry asks for: query_id, citation_key, title, authors, year, doi, arxiv_id, preferred_venues."""
    return lock.select(*query_columns())


def sources_of() -> Column:
    return recommended_sources(F.col("record.venue"), F.col("record.url"), F.col("record.doi"), F.col("record.arxiv_id"))


def source_commands(sources: Column) -> Column:
    """What is to be run for each source: discovery, decision, export."""
    return F.transform(
        sources,
        lambda s: F.struct(
            s.alias("source"),
            F.concat(F.lit("discover --source "), s, F.lit(" --query QUERY_JSON --live --json")).alias("discover"),
            F.lit("resolve --query QUERY_JSON --candidates CANDIDATES_JSON --json").alias("resolve"),
            F.lit("fetch-bibtex --resolved RESOLVED_JSON --write-lock LOCK_JSON --json").alias("fetch_bibtex"),
        ),
    )


def work_items(lock: DataFrame, include_verified: bool = False) -> DataFrame:
    """Entries that still want a verified record: citation_key, status, query, recommended_sources, source_commands."""
    open_ = lock if include_verified else unverified(lock)
    given = ["project"] if "project" in lock.columns else []
    rows = open_.select(*given, "citation_key", "status", F.struct(*query_columns()).alias("query"), sources_of().alias("recommended_sources"))
    return rows.withColumn("source_commands", source_commands(F.col("recommended_sources")))


def reference_summary() -> Column:
    """What a review shows of an entry."""
    b = F.col("bibtex")
    kept = F.struct(*(b[f].alias(f) for f in ("source_kind", "raw_sha256", "normalized_sha256", "fallback_reason", "field_checks")))
    return F.struct("citation_key", "status", "record", "authority", kept.alias("bibtex"))


def checks(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def starter_entries(bib: DataFrame, as_of: str) -> DataFrame:
    """Lock entries of a bibliography alone, which can't pass until they are resolved. bib: citation_key, entry_type, fields, raw_text."""
    f = lambda n: or_none(F.try_element_at("fields", F.lit(n)))
    had = lambda c: F.when(c.isNotNull(), "present").otherwise("missing")
    url = F.coalesce(f("url"), F.lit(""))
    authors = F.filter(F.transform(F.split(F.coalesce(f("author"), F.lit("")), r"\s+and\s+"), strip), present)
    none = F.lit(None).cast("string")
    raw = F.coalesce("raw_text", F.lit(""))
    return bib.select(
        "citation_key", F.coalesce(short_title(f("title")), F.col("citation_key")).alias("short_title"), F.lit("missing_bibtex_provenance").alias("status"),
        F.struct(f("title").alias("title"), authors.alias("authors"), f("year").alias("year"), F.coalesce(f("booktitle"), f("journal"), f("howpublished")).alias("venue"), f("doi").alias("doi"), f("eprint").alias("arxiv_id"), url.alias("url"), none.alias("accessed_at")).alias("record"),
        F.struct(F.lit("unverified_bibtex").alias("source"), url.alias("record_url"), F.lit("paper_record").alias("record_type"), F.lit(99).alias("source_priority"), none.alias("bibtex_url")).alias("authority"),
        F.struct(
            F.coalesce("entry_type", F.lit("misc")).alias("entry_type"), F.col("citation_key"), F.lit("unknown").alias("source_kind"), sha256(raw).alias("raw_sha256"), sha256(canonical(raw)).alias("normalized_sha256"), none.alias("canonical_text"), none.alias("fallback_reason"),
            checks(title=had(f("title")), first_author=had(f("author")), year=had(f("year")), doi=had(f("doi")), url=had(f("url")), bibtex_source=F.lit("missing_provenance")).alias("field_checks"),
        ).alias("bibtex"),
        F.struct(F.lit(0).alias("score"), F.array(F.lit("MISSING_BIBTEX_PROVENANCE")).alias("blocking_issues"), F.array().cast("array<string>").alias("warnings"), F.array(F.lit("bootstrapped from existing BibTeX without authority verification")).alias("decision_trace")).alias("resolver"),
        F.lit(as_of).alias("checked_at"), F.lit("provlake").alias("checked_by"),
    )


ARXIV_REASON = "Official publication BibTeX was not confirmed; arXiv record was verified as fallback provenance."


def built_entries(selected: DataFrame, as_of: str, fallback_reason: str | None = None) -> DataFrame:
    """Lock entries of selected records with their BibTeX.

    selected: citation_key (null: the entry's own), status, score, trace, authority, c_title, c_authors, c_year, c_venue,
    c_doi, c_arxiv_id, c_url, raw (map), bibtex (a record), b_doi (of the entry's fields). A status of an official export
    falls to a manual one if the BibTeX is no export; the text is kept under the lock's key.
    """
    b = F.col("bibtex")
    official, arxiv = b["source_kind"] == "official_export", b["source_kind"] == "arxiv_manual_normalized"
    reason = F.coalesce(F.lit(fallback_reason), F.when(arxiv, F.lit(ARXIV_REASON)))
    doi = F.coalesce(or_none(F.col("c_doi")), or_none(F.col("b_doi")))
    key = F.coalesce(or_none(F.col("citation_key")), b["citation_key"])
    text = F.when(b["citation_key"] == key, b["raw_text"]).otherwise(rekeyed(strip(b["raw_text"]), key))
    had = lambda ok, other="missing": F.when(ok, "checked").otherwise(other)
    source = F.when(official, "official_export").when(reason.isNotNull(), "manual_fallback_with_reason").otherwise("manual_fallback_reason_missing")
    own = checks(
        title=F.lit("checked"), first_author=had(F.size("c_authors") > 0), year=had(F.col("c_year").isNotNull()), doi=had(doi.isNotNull()),
        arxiv_id=had(present(F.col("c_arxiv_id")), "not_applicable"), url=had(present(F.col("c_url"))), bibtex_source=source,
    )
    own = F.when(official, F.map_concat(own, F.create_map(F.lit("exported_citation_key"), b["citation_key"]))).otherwise(own)
    accessed = F.coalesce(F.try_element_at("raw", F.lit("accessed_at")), F.when(arxiv, F.lit(as_of)))
    none = F.array().cast("array<string>")
    return selected.select(
        key.alias("citation_key"), F.coalesce(short_title(F.col("c_title")), F.lit("")).alias("short_title"),
        F.when((F.col("status") == "verified_official_bibtex") & ~official, "verified_manual_fallback").otherwise(F.col("status")).alias("status"),
        F.struct(F.col("c_title").alias("title"), F.col("c_authors").alias("authors"), F.col("c_year").cast("string").alias("year"), F.col("c_venue").alias("venue"), doi.alias("doi"), F.col("c_arxiv_id").alias("arxiv_id"), F.col("c_url").alias("url"), accessed.alias("accessed_at")).alias("record"),
        "authority",
        F.struct(b["entry_type"].alias("entry_type"), key.alias("citation_key"), b["source_kind"].alias("source_kind"), b["raw_sha256"].alias("raw_sha256"), sha256(canonical(text)).alias("normalized_sha256"), canonical(text).alias("canonical_text"), reason.alias("fallback_reason"), own.alias("field_checks")).alias("bibtex"),
        F.struct(F.col("score").cast("int").alias("score"), none.alias("blocking_issues"), none.alias("warnings"), F.coalesce("trace", none).alias("decision_trace")).alias("resolver"),
        F.lit(as_of).alias("checked_at"), F.lit("provlake").alias("checked_by"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's entries in place of those of the same keys, by key."""
    kept = [c for c in old.columns if c in new.columns]
    return upsert(old.select(*kept), new.select(*kept), "citation_key").orderBy("citation_key")


def by_source_kind(lock: DataFrame) -> DataFrame:
    """section, citation_key, detail: entries as a report lists them, by where their BibTeX comes from."""
    kind = F.col("bibtex.source_kind")
    section = F.when(kind == "official_export", "official").when(kind == "publisher_metadata_manual_normalized", "manual").when(kind == "arxiv_manual_normalized", "arxiv")
    detail = (
        F.when(kind == "official_export", F.concat_ws(": ", "authority.source", "authority.bibtex_url"))
        .when(kind == "publisher_metadata_manual_normalized", F.coalesce("bibtex.fallback_reason", F.lit("reason missing")))
        .otherwise(F.concat(F.coalesce("record.arxiv_id", F.lit("")), F.lit(" ("), F.coalesce(or_none(F.col("record.accessed_at")), F.lit("accessed date missing")), F.lit(")")))
    )
    return lock.select(section.alias("section"), "citation_key", detail.alias("detail")).where("section is not null")


# --- handoff ------------------------------------------------------------------------------------------


def month(c: Column) -> Column:
    """1 to 12 of a month's number or name, by its first letters; null for others."""
    m = F.lower(F.regexp_replace(c, r"^[{}]+|[{}]+$", ""))
    named = F.array_position(F.array(*map(F.lit, K.MONTHS)), F.substring(m, 1, 3)).cast("int")
    return F.when(F.regexp_like(m, F.lit(r"^\d+$")), F.when(m.try_cast("int").between(1, 12), m.try_cast("int"))).otherwise(F.nullif(named, F.lit(0)))


def date_parts(c: Column) -> Column:
    """A date's parts as JSON: numbers of year, month and day, as far as they are there; else the text itself."""
    parts = F.split(c, "-")
    numbers = F.array_join(F.transform(parts, lambda x: x.try_cast("int").cast("string")), ",")
    whole = F.regexp_like(c, F.lit(r"^\d+(?:-\d+){0,2}$"))
    return F.when(present(c), F.concat(F.lit("[["), F.when(whole, numbers).otherwise(json_text(c)), F.lit("]]")))


def json_text(c: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def csl_authors(c: Column) -> Column:
    """Names that " and " joins, as family and given, or as they are if they are one word."""

    def person(a: Column) -> Column:
        words = F.filter(F.split(a, r"\s+"), lambda w: w != "")
        n = F.size(words)
        comma = F.contains(a, F.lit(","))
        family = F.when(comma, strip(F.regexp_extract(a, r"(?s)^([^,]*),", 1))).when(n > 1, F.element_at(words, -1))
        given = F.when(comma, strip(F.regexp_extract(a, r"(?s)^[^,]*,(.*)$", 1))).when(n > 1, F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " "))
        return F.struct(family.alias("family"), given.alias("given"), F.when(~comma & (n <= 1), a).alias("literal"))

    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), " and "), strip), present)
    return F.when(F.size(names) > 0, F.transform(names, person))


#: Fields of an item that are taken over, and which of an entry's they may be.
COPIED = {
    "page": ("pages",), "volume": ("volume",), "issue": ("number", "issue"), "publisher": ("publisher", "institution", "school"), "publisher-place": ("address",), "edition": ("edition",), "ISBN": ("isbn",), "ISSN": ("issn",),
    "abstract": ("abstract",), "keyword": ("keywords", "keyword"), "archive": ("archiveprefix",), "archive_location": ("eprint",), "PMID": ("pmid",), "note": ("note",),
}


def csl_items(bib: DataFrame, lock: DataFrame) -> DataFrame:
    """citation_key, item (JSON), and its parts by name: one CSL item for each lock entry, with the bibliography's fields if there are any.

    bib: citation_key, entry_type, fields; lock: entries. Empty parts are left out.
    """
    kinds = F.create_map(*(F.lit(x) for kv in K.CSL_KINDS.items() for x in kv))
    j = lock.join(bib.select("citation_key", "entry_type", "fields"), "citation_key", "left")
    f = lambda n: or_none(F.try_element_at("fields", F.lit(n)))
    r = lambda n: or_none(F.col(f"record.{n}"))
    year = F.coalesce(f("year"), r("year"))
    number = F.when(F.regexp_like(year, F.lit(r"^\d+$")), year.try_cast("long").cast("string")).otherwise(json_text(year))
    issued = F.when(year.isNotNull(), F.concat(F.lit("[["), F.concat_ws(",", number, month(f("month")).cast("string")), F.lit("]]")))
    dates = lambda c: F.when(c.isNotNull(), F.parse_json(F.concat(F.lit('{"date-parts":'), c, F.lit("}"))))
    state = F.struct(F.col("status"), F.col("authority.source").alias("authority_source"), F.col("authority.record_url").alias("authority_url"), F.col("bibtex.source_kind").alias("bibtex_source_kind"), F.col("bibtex.raw_sha256").alias("bibtex_raw_sha256"))
    parts = {
        "id": F.col("citation_key"), "type": F.coalesce(F.try_element_at(kinds, F.coalesce("entry_type", F.lit("misc"))), F.lit("webpage")), "title": F.coalesce(f("title"), r("title")), "author": csl_authors(f("author")),
        "issued": dates(issued), "accessed": dates(date_parts(F.coalesce(r("accessed_at"), f("urldate")))), "DOI": F.coalesce(f("doi"), r("doi")), "URL": F.coalesce(f("url"), r("url")), "container-title": F.coalesce(f("booktitle"), f("journal"), r("venue")),
    }
    parts |= {k: F.coalesce(*(f(n) for n in names)) for k, names in COPIED.items()}
    return j.select("citation_key", F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()), state.alias("_provenance"))).alias("item"))


def handoff(bib: DataFrame, lock: DataFrame) -> DataFrame:
    """citation_key, entry (JSON) of each lock entry by key: its record, authority, provenance, the bibliography's fields, and its item."""
    items = csl_items(bib, lock)
    j = lock.join(bib.select("citation_key", "fields"), "citation_key", "left").join(items, "citation_key")
    entry = F.struct("citation_key", "status", "record", "authority", F.col("bibtex").alias("bibtex_provenance"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("bibtex"), F.parse_json("item").alias("csl"))
    return j.select("citation_key", F.to_json(entry).alias("entry")).orderBy("citation_key")
