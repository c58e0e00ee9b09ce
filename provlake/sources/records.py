"""Publisher records: pages with meta tags and scripts, Atom feeds and JSON answers as candidates, and what follows from them.

Candidates have the columns that ``resolve`` takes: c_source, c_title, c_authors, c_year, c_venue, c_doi, c_arxiv_id,
c_url, c_official, c_bibtex_url, c_priority, c_pending, raw. Pages and answers come from files, the cache or a fetch
stage; nothing here reads the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import arxiv_parts, first_present, host_matches, joined_url, normalize_author, normalize_title, or_none, present, sha256, squeezed, strip, unescaped
from provlake.sources.parsers import bibtex_record


CANDIDATE = ["c_source", "c_title", "c_authors", "c_year", "c_venue", "c_doi", "c_arxiv_id", "c_url", "c_official", "c_bibtex_url", "c_priority", "c_pending", "raw"]


def nothing() -> Column:
    return F.lit(None).cast("string")


def raw_map(**parts: Column) -> Column:
    """A map of what else a record says; empty values are left out."""
    whole = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


# --- pages ------------------------------------------------------------------------------------------

ATTRIBUTE = r"([A-Za-z_:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
ANCHOR = r"(?is)<a\s+[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def attribute(tag: Column, *names: str) -> Column:
    """The last value of the first of the names that a tag has, and which may be empty."""
    keys = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = [F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i)) for i in (2, 3, 4)]
    pairs = F.arrays_zip(keys.alias("k"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    text = lambda x: F.concat(x["v0"], x["v1"], x["v2"])

    def named(n: str) -> Column:
        own = F.filter(pairs, lambda x: x["k"] == n)
        return F.when(F.size(own) > 0, text(F.element_at(own, -1)))

    found = [named(n) for n in names]
    return found[0] if len(found) == 1 else F.coalesce(*(or_none(x) for x in found))


def metas(html: Column) -> Column:
    """array of struct(name, content) of meta tags that have both; entities stay as they are."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+[^>]*>"), F.lit(0))
    both = F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name", "property")).alias("name"), squeezed(attribute(t, "content")).alias("content")))
    return F.filter(both, lambda x: x["name"].isNotNull() & x["content"].isNotNull())


def anchors(html: Column) -> Column:
    """array of struct(href, label); entities stay as they are."""
    label = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)), lambda x: squeezed(F.regexp_replace(x, "<[^>]+>", "")))
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), label.alias("label"))


def inline_bibtex(html: Column) -> Column:
    """BibTeX that a page holds in its code, pre or textarea element of that id; entities stay as they are."""
    found = []
    for tag in ("code", "pre", "textarea"):
        text = strip(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\bid=[\"']bibtex[\"'][^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""))
        found.append(F.when(F.regexp_like(text, F.lit(r"^@\w+\s*\{")), F.concat(text, F.lit("\n"))))
    return F.coalesce(*found)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (url, html) with _meta (array of name, content), _links (array of href, label) and _inline, as plain text."""
    rows = pages.withColumns({"_m": metas(F.col("html")), "_a": anchors(F.col("html")), "_inline": inline_bibtex(F.col("html"))})
    plain = lambda c: unescaped(c)
    rows = rows.withColumns({"_mc": plain(F.transform("_m", lambda x: x["content"])), "_ah": plain(F.transform("_a", lambda x: x["href"])), "_al": plain(F.transform("_a", lambda x: x["label"])), "_it": plain(F.array("_inline"))})
    rows = rows.withColumns(
        {
            "_meta": F.arrays_zip(F.transform("_m", lambda x: x["name"]).alias("name"), F.col("_mc").alias("content")),
            "_links": F.arrays_zip(F.col("_ah").alias("href"), F.col("_al").alias("label")),
            "_inline": F.get("_it", F.lit(0)),
        }
    )
    return rows.drop("_m", "_a", "_mc", "_ah", "_al", "_it")


def contents(name: str) -> Column:
    """All contents of a meta tag; of ``parsed`` rows."""
    return F.transform(F.filter("_meta", lambda x: x["name"] == name.lower()), lambda x: x["content"])


def content(*names: str) -> Column:
    """The first content that isn't empty, names in order; of each the first counts."""
    return F.coalesce(*(or_none(F.get(contents(n), F.lit(0))) for n in names))


def bibtex_endpoint(base: str = "url", found_by: str = "html_anchor_text") -> Column:
    """struct(url, discovered_by) of a page's BibTeX: named by a meta tag, linked, or on the page; null if there is none."""
    named = [F.when(content(n).isNotNull(), F.struct(content(n).alias("url"), F.lit(n).alias("discovered_by"))) for n in ("citation_bibtex_url", "bibtex_url", "dc.bibtex")]

    def speaks(x: Column) -> Column:
        href, label = F.lower(x["href"]), F.lower(x["label"])
        return F.contains(label, F.lit("bibtex")) | F.endswith(href, F.lit(".bib")) | F.contains(href, F.lit("/bibtex")) | F.contains(href, F.lit("format=bibtex"))

    link = F.get(F.transform(F.filter("_links", speaks), lambda x: x["href"]), F.lit(0))
    linked = F.when(link.isNotNull(), F.struct(link.alias("url"), F.lit(found_by).alias("discovered_by")))
    inline = F.when(F.col("_inline").isNotNull(), F.struct(F.col(base).alias("url"), F.lit("inline_bibtex_code").alias("discovered_by")))
    return F.coalesce(*named, linked, inline)


def doi_of_page() -> Column:
    value = content("citation_doi", "dc.identifier", "dc.identifier.doi", "prism.doi", "doi")
    doi = or_none(F.regexp_extract(value, r"(?i)10\.\d{4,9}/\S+", 0))
    return F.coalesce(F.regexp_replace(doi, "[ .;,]+$", ""), strip(value))


def year_in(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1).try_cast("int")


# --- what scripts on pages say -----------------------------------------------------------------------


def json_value(html: Column, field: str, nested: str | None = None) -> Column:
    """A field's text in scripts, quotes with or without a backslash; entities stay as they are."""
    plain = F.replace(html, F.lit('\\"'), F.lit('"'))
    pattern = rf'(?s)"{field}"\s*:\s*"([^"]+)"' if nested is None else rf'(?s)"{field}"\s*:\s*\{{.*?"{nested}"\s*:\s*"([^"]+)"'
    return or_none(F.regexp_extract(plain, pattern, 1))


def json_names(html: Column) -> Column:
    """Names of a script's authors."""
    plain = F.replace(html, F.lit('\\"'), F.lit('"'))
    block = F.coalesce(*(or_none(F.regexp_extract(plain, rf'(?s)"{f}"\s*:\s*\[(.*?)\]', 1)) for f in ("author", "authors")), F.lit(""))
    return F.regexp_extract_all(block, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1))


def acm_doi(url: Column) -> Column:
    return or_none(F.regexp_replace(F.regexp_extract(url, r"(?i)dl\.acm\.org/doi/(?:abs/|pdf/)?(10\.\d{4,9}/[^?#]+)", 1), "/+$", ""))


def acm_bibtex(doi: Column) -> Column:
    coded = F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://dl.acm.org/action/exportCiteProcCitation?dois="), coded, F.lit("&targetFile=custom-bibtex&format=bibTex"))


def acl_id(url: Column) -> Column:
    return or_none(F.regexp_extract(url, r"aclanthology\.org/([A-Za-z0-9.-]+)/?", 1))


def acl_bibtex(url: Column) -> Column:
    return F.concat(F.lit("https://aclanthology.org/"), acl_id(url), F.lit(".bib"))


def abstract_url(url: Column, host: str) -> Column:
    """The record page of a proceedings PDF; other addresses stay."""
    page = F.replace(F.regexp_replace(F.replace(url, F.lit("/file/"), F.lit("/hash/")), r"\.pdf$", ".html"), F.lit("-Paper-"), F.lit("-Abstract-"))
    return F.when(F.contains(url, F.lit(f"proceedings.{host}")), page).otherwise(url)


ARXIV_LINK = r"(?i)arxiv\.org/(?:abs|pdf)/([0-9.]+)(?:v\d+)?"


def candidates(pages: DataFrame) -> DataFrame:
    """pages (source, url, html, and what else they have) with a candidate's columns.

    One pass over a page for all venues: meta tags first, then what ACM, IEEE and OpenReview have in scripts. ACL's
    export address follows from the record's.
    """
    html, source = F.col("html"), F.col("source")
    acm, ieee, review, acl = (source == s for s in ("acm", "ieee", "openreview", "acl"))
    rows = parsed(pages)
    # texts of scripts, which need their entities replaced, in one array
    script = F.when(acm, F.array(*(F.coalesce(json_value(html, *f), F.lit("")) for f in (("doi",), ("name",), ("headline",), ("datePublished",), ("publicationDate",), ("isPartOf", "name"), ("container-title",)))))
    decoded = F.replace(F.replace(html, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    open_value = lambda f: F.regexp_extract(decoded, rf'(?s)"{f}"\s*:\s*"([^"]*)"', 1)
    open_names = F.regexp_extract_all(F.replace(F.regexp_extract(html, r'(?s)\\?"authors\\?"\s*:\s*\[(.*?)\]', 1), F.lit('\\"'), F.lit('"')), F.lit('"([^"]*)"'), F.lit(1))
    script = script.when(review, F.array(*(open_value(f) for f in ("venue", "_bibtex", "html", "pdf"))))
    names = F.when(acm, json_names(html)).when(review, open_names)
    rows = rows.withColumns({"_script": unescaped(script), "_names": unescaped(names), "_end": bibtex_endpoint()})
    at = lambda i: or_none(F.get("_script", F.lit(i)))
    rows = rows.withColumns({"_bib": joined_url(F.col("url"), F.col("_end.url")), "_authors": F.transform(contents("citation_author"), squeezed)})
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for s, n, _ in K.VENUES for x in (s, n))), source), F.lit("Official venue"))
    venue = content("citation_conference_title", "citation_journal_title", "citation_inbook_title", "prism.publicationName", "dc.source")
    ieee_value = lambda f: F.when(ieee, or_none(F.regexp_extract(html, rf'"{f}"\s*:\s*"([^"]+)"', 1)))
    block = F.regexp_extract(html, r'(?s)"authors"\s*:\s*\[(.*?)\]\s*,\s*"(?:isbn|issn|articleNumber)"', 1)
    authors = (
        F.when(review & (F.size(F.coalesce("_names", F.array().cast("array<string>"))) > 0), F.col("_names"))
        .when(F.size("_authors") > 0, F.col("_authors"))
        .when(acm, F.col("_names"))
        .when(ieee, F.regexp_extract_all(block, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1)))
        .otherwise(F.col("_authors"))
    )
    year = F.coalesce(
        F.when(review, or_none(F.regexp_extract(F.coalesce(at(1), F.lit("")), r"(?i)\byear\s*=\s*\{?(\d{4})", 1)).cast("int")),
        year_in(content("citation_publication_date")),
        F.when(acm, year_in(F.coalesce(at(3), at(4)))),
        F.when(ieee, F.regexp_extract(html, r'"publicationYear"\s*:\s*"?(\d{4})', 1).try_cast("int")),
    )
    doi = F.when(acl, nothing()).otherwise(F.coalesce(doi_of_page(), F.when(acm, F.coalesce(acm_doi(F.col("url")), at(0))), ieee_value("doi")))
    linked = lambda c: or_none(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), ARXIV_LINK, 1), r"\.+$", ""))
    arxiv = F.when(review, F.coalesce(linked(at(1)), linked(at(2)), linked(at(3))))
    places = F.when(acl, F.lit("ACL Anthology")).otherwise(F.coalesce(F.when(review, at(0)), F.when(venue != label, venue), F.when(acm, F.coalesce(at(5), at(6))), ieee_value("displayPublicationTitle"), label))
    title = F.coalesce(content("citation_title", "og:title"), F.when(acm, F.coalesce(at(1), at(2))), ieee_value("title"), F.lit(""))
    rows = rows.withColumns({"c_doi": doi, "c_venue": places, "c_year": year, "c_title": title, "c_authors": F.coalesce(authors, F.array().cast("array<string>")), "c_arxiv_id": arxiv})
    export = (
        F.when(review, nothing())
        .when(acl, F.coalesce(content("citation_bibtex_url"), acl_bibtex(F.col("url"))))
        .otherwise(F.coalesce("_bib", F.when(acm, acm_bibtex(F.col("c_doi")))))
    )
    given = [c for c in pages.columns if c not in ("source", "url", "html")]
    return rows.select(
        *given, source.alias("c_source"), "c_title", "c_authors", "c_year", "c_venue", "c_doi", "c_arxiv_id", F.col("url").alias("c_url"), F.lit(True).alias("c_official"),
        export.alias("c_bibtex_url"), F.lit(1).alias("c_priority"), F.lit(False).alias("c_pending"),
        raw_map(metadata_source=F.concat(source, F.lit("_html")), acl_id=F.when(acl, acl_id(F.col("url"))), official_bibtex_status=F.when(review, F.lit("not_discovered")), embedded_bibtex_present=F.when(review & at(1).isNotNull(), F.lit("true"))).alias("raw"),
    )


def preferred_pages(queries: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """query_id, ord, source, url: which of a query's preferred venues are record pages of a source, by their host."""
    hosts = [(s, d) for s, _, d in K.VENUES if sources is None or s in sources]
    v = queries.select("query_id", F.posexplode("preferred_venues").alias("ord", "url"))
    url = F.col("url")
    own = {"acl": F.contains(url, F.lit("aclanthology.org")), "iclr": F.contains(url, F.lit("iclr.cc")), "neurips": F.contains(url, F.lit("neurips.cc"))}
    found = F.filter(F.array(*(F.when(own.get(s, host_matches(url, F.lit(d))), F.lit(s)) for s, d in hosts)), lambda x: x.isNotNull())
    v = v.select("query_id", "ord", "url", F.explode(found).alias("source"))
    page = F.when(F.col("source") == "iclr", abstract_url(url, "iclr.cc")).when(F.col("source") == "neurips", abstract_url(url, "neurips.cc")).otherwise(url)
    return v.select("query_id", "ord", "source", page.alias("url"))


def consistent(found: DataFrame, normal: bool = True) -> DataFrame:
    """Candidates whose title is the query's, and whose year, where both have one. found: q_title, q_year, c_title, c_year."""
    same = normalize_title(F.coalesce("c_title", F.lit("")), normal) == normalize_title(F.coalesce("q_title", F.lit("")), normal)
    year = F.coalesce(F.col("q_year") == F.col("c_year"), F.lit(True))
    return found.where((~present(F.col("q_title")) | same) & year)


#: Sources of which only candidates with the query's title count; the others' titles are checked by the resolver.
BY_TITLE = ["acl", "iclr", "neurips", "openalex", "semantic_scholar"]


def discovered(found: DataFrame, normal: bool = True) -> DataFrame:
    """What a lookup gives of the candidates it finds: q_title, q_doi, q_arxiv_id beside a candidate's columns.

    Crossref's are taken as they are where the query has a DOI, arXiv's by number (and version, if the query has one)
    where it has a number; else, and for the sources of ``BY_TITLE``, titles must agree.
    """
    same = normalize_title(F.coalesce("c_title", F.lit("")), normal) == normalize_title(F.coalesce("q_title", F.lit("")), normal)
    free = ~present(F.col("q_title"))
    s = F.col("c_source")
    keep = (
        F.when(s == "crossref", present(F.col("q_doi")) | same)
        .when((s == "arxiv") & present(F.col("q_arxiv_id")), arxiv_matches(F.col("q_arxiv_id"), F.col("c_arxiv_id"), F.try_element_at("raw", F.lit("arxiv_version"))))
        .when((s == "arxiv") | (s == "semantic_scholar"), same)
        .when(s.isin(BY_TITLE), free | same)
        .otherwise(F.lit(True))
    )
    return found.where(keep)


# --- Atom and JSON answers ---------------------------------------------------------------------------


def arxiv_matches(asked: Column, number: Column, version: Column) -> Column:
    base, wanted = arxiv_parts(asked)
    return F.coalesce((F.lower(base) == F.lower(number)) & (wanted.isNull() | (F.lower(F.coalesce(version, F.lit(""))) == F.lower(wanted))), F.lit(False))


def arxiv_candidates(feeds: DataFrame, accessed_at: str | None = None) -> DataFrame:
    """Entries of Atom feeds: feeds has query_id, preferred_venues, body, and what else; accessed_at is a date as text.

    An entry with neither DOI nor journal is pending if the query prefers a venue that is no preprint server.
    """
    given = [c for c in feeds.columns if c not in ("body", "ord")]
    e = feeds.select(*given, F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<entry\b[^>]*>.*?</entry>"), F.lit(0))).alias("ord", "_e"))
    entry = F.regexp_replace("_e", r"^<entry\b[^>]*>", "<entry>")
    text = lambda path: squeezed(F.xpath_string(F.col("_e"), F.lit(path)))
    e = e.withColumn("_e", entry)
    e = e.withColumns({"_id": text("/entry/id"), "_doi": or_none(text("//*[name()='arxiv:doi']")), "_journal": or_none(text("//*[name()='arxiv:journal_ref']"))})
    number, version = arxiv_parts(F.regexp_extract("_id", r"([^/]*)$", 1))
    e = e.withColumns({"_number": number, "_version": version, "_date": F.coalesce(or_none(text("/entry/published")), text("/entry/updated"))})
    venues = F.filter(F.coalesce("preferred_venues", F.array().cast("array<string>")), lambda v: ~F.contains(F.lower(v), F.lit("arxiv")) & ~F.contains(F.lower(v), F.lit("preprint")))
    state = F.when(F.col("_doi").isNotNull() | F.col("_journal").isNotNull(), "linked_publication_metadata").when(F.size(venues) > 0, "official_record_pending").otherwise("preprint_only")
    e = e.withColumn("_state", state)
    url = F.when(F.col("_number") != "", F.concat(F.lit("https://arxiv.org/abs/"), "_number", F.coalesce("_version", F.lit("")))).otherwise(F.col("_id"))
    authors = F.filter(F.transform(F.xpath("_e", F.lit("/entry/author/name/text()")), squeezed), lambda x: x != "")
    pending = F.col("_state") == "official_record_pending"
    return e.select(
        *given, "ord", F.lit("arxiv").alias("c_source"), text("/entry/title").alias("c_title"), authors.alias("c_authors"),
        F.when(F.regexp_like("_date", F.lit(r"^\d{4}")), F.substring("_date", 1, 4).cast("int")).alias("c_year"), F.coalesce("_journal", F.lit("arXiv preprint")).alias("c_venue"), F.col("_doi").alias("c_doi"),
        F.col("_number").alias("c_arxiv_id"), url.alias("c_url"), F.lit(True).alias("c_official"), nothing().alias("c_bibtex_url"), F.lit(2).alias("c_priority"), pending.alias("c_pending"),
        raw_map(
            arxiv_id=F.col("_number"), arxiv_version=F.col("_version"), accessed_at=F.lit(accessed_at), published=text("/entry/published"), updated=text("/entry/updated"), summary=text("/entry/summary"),
            primary_category=or_none(F.xpath_string(F.col("_e"), F.lit("//*[name()='arxiv:primary_category']/@term"))), official_record_status=F.col("_state"), bibtex_source_kind=F.lit("arxiv_manual_normalized"), final_authority_source=F.when(~pending, F.lit("arxiv")),
        ).alias("raw"),
    )


def first_of(json: Column, path: str) -> Column:
    """A value, or the first of a list of them."""
    whole = F.get_json_object(json, path)
    return F.when(F.startswith(whole, F.lit("[")), F.get_json_object(json, path + "[0]")).otherwise(whole)


def items_of(answers: DataFrame, path: str, single: str | None = None) -> DataFrame:
    """answers (body) with ord and _item: each object of the list at path, or the one at ``single``."""
    given = [c for c in answers.columns if c not in ("body", "ord")]
    some = F.from_json(F.get_json_object("body", path), "array<string>")
    if single:
        some = F.when(F.get_json_object("body", path).isNotNull(), some).otherwise(F.array(F.get_json_object("body", single)))
    return answers.select(*given, F.posexplode(some).alias("ord", "_item")).where("_item is not null")


def json_candidates(answers: DataFrame, source: str) -> DataFrame:
    """Candidates of JSON answers (body, and what else) of crossref, openalex or semantic_scholar."""
    i = F.col("_item")
    get = lambda p: F.get_json_object(i, p)
    text = lambda p: or_none(get(p))
    some = lambda p, kind: F.from_json(get(p), kind)
    no = F.array().cast("array<string>")
    if source == "crossref":
        rows = items_of(answers, "$.message.items", "$.message")
        names = F.transform(some("$.author", "array<struct<given:string,family:string>>"), lambda a: strip(F.concat_ws(" ", or_none(a["given"]), or_none(a["family"]))))
        years = [get(f"$.{k}.date-parts[0][0]").try_cast("int") for k in ("published-print", "published-online", "published", "issued")]
        parts = {
            "title": F.coalesce(first_of(i, "$.title"), F.lit("")), "authors": names, "year": F.coalesce(*years), "venue": first_present(first_of(i, "$.container-title"), first_of(i, "$.short-container-title")),
            "doi": text("$.DOI"), "arxiv": nothing(), "url": F.coalesce(text("$.URL"), F.concat(F.lit("https://doi.org/"), text("$.DOI"))), "official": text("$.DOI").isNotNull(), "priority": 2,
            "raw": raw_map(metadata_source=F.lit(source), type=text("$.type"), publisher=text("$.publisher"), reference_count=text("$.reference-count")),
        }
    elif source == "openalex":
        rows = items_of(answers, "$.results")
        names = F.transform(some("$.authorships", "array<struct<author:struct<display_name:string>>>"), lambda a: a["author"]["display_name"])
        parts = {
            "title": F.coalesce(text("$.title"), text("$.display_name"), F.lit("")), "authors": names, "year": get("$.publication_year").try_cast("int"), "venue": text("$.primary_location.source.display_name"),
            "doi": F.regexp_replace(text("$.doi"), r"^https://doi\.org/", ""), "arxiv": nothing(), "url": F.coalesce(text("$.primary_location.landing_page_url"), text("$.id")), "official": F.lit(False), "priority": 4,
            "raw": raw_map(metadata_source=F.lit(source), openalex_id=text("$.id"), authority_role=F.lit("discovery_cross_check"), primary_location=text("$.primary_location")),
        }
    elif source == "semantic_scholar":
        rows = items_of(answers, "$.data")
        names = F.transform(some("$.authors", "array<struct<name:string>>"), lambda a: a["name"])
        parts = {
            "title": F.coalesce(text("$.title"), F.lit("")), "authors": names, "year": get("$.year").try_cast("int"), "venue": text("$.venue"),
            "doi": text("$.externalIds.DOI"), "arxiv": text("$.externalIds.ArXiv"), "url": text("$.url"), "official": F.lit(False), "priority": 4,
            "raw": raw_map(metadata_source=F.lit(source), paper_id=text("$.paperId"), external_ids=text("$.externalIds"), authority_role=F.lit("discovery_only")),
        }
    else:
        raise ValueError(f"no JSON answers of {source}")
    given = [c for c in rows.columns if c != "_item"]
    authors = F.filter(F.coalesce(parts["authors"], no), lambda x: present(x))
    return rows.select(
        *given, F.lit(source).alias("c_source"), parts["title"].alias("c_title"), authors.alias("c_authors"), parts["year"].alias("c_year"), parts["venue"].alias("c_venue"), parts["doi"].alias("c_doi"), parts["arxiv"].alias("c_arxiv_id"),
        parts["url"].alias("c_url"), parts["official"].alias("c_official"), nothing().alias("c_bibtex_url"), F.lit(parts["priority"]).alias("c_priority"), F.lit(False).alias("c_pending"), parts["raw"].alias("raw"),
    )


# --- what candidates lead to -------------------------------------------------------------------------


def authority(source: Column, url: Column, priority: Column, bibtex_url: Column) -> Column:
    """The authority that a candidate of a source stands for; null for indexes that only discover, and without address."""
    kinds = {s: "conference_proceedings" for s, _, _ in K.VENUES} | {s: k for s, _, k in K.INDEXES if k}
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), source)
    index = source.isin([s for s, _, _ in K.INDEXES])
    export = F.when(index, nothing()).when(source == "acl", F.coalesce(bibtex_url, acl_bibtex(url))).otherwise(bibtex_url)
    return F.when(kind.isNotNull() & present(url), F.struct(source.alias("source"), url.alias("record_url"), kind.alias("record_type"), priority.alias("source_priority"), export.alias("bibtex_url")))


def export_endpoint(authority_: Column) -> Column:
    """struct(url, discovered_by) of an authority's BibTeX, as far as it is known without its page."""
    a = authority_
    acl = F.coalesce(a["bibtex_url"], acl_bibtex(a["record_url"]))
    by = F.when(a["source"] == "acl", "acl_id_pattern").when(a["bibtex_url"] == a["record_url"], "inline_bibtex_code").otherwise("citation_bibtex_url")
    url = F.when(a["source"].isin([s for s, _, _ in K.INDEXES]), nothing()).when(a["source"] == "acl", acl).otherwise(a["bibtex_url"])
    return F.when(present(url), F.struct(url.alias("url"), by.alias("discovered_by")))


def fetched_bibtex(discovered_by: Column, body: Column, inline: Column) -> Column:
    """The record of an export: the answer's text, or the entry on the page where that is the export."""
    return bibtex_record(F.when(discovered_by == "inline_bibtex_code", inline).otherwise(body))


def bibtex_value(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def default_key(normal: bool = True) -> Column:
    """A citation key of a candidate: first author's last name, year, first word of the title."""
    name = F.element_at(F.split(normalize_author(F.coalesce(F.get("c_authors", F.lit(0)), F.lit("arxiv")), normal), " "), -1)
    word = F.regexp_replace(F.get(F.split(normalize_title(F.col("c_title"), normal), " "), F.lit(0)), "[^a-z0-9]+", "")
    return F.concat(F.when(name == "", "arxiv").otherwise(name), F.coalesce(F.col("c_year").cast("string"), F.lit("nd")), F.when(word == "", "preprint").otherwise(word))


def entry_text(key: Column, fields: list[tuple[str, Column]]) -> Column:
    """A @misc entry of those fields that aren't empty."""
    lines = F.filter(F.array(*(F.when(present(v), F.concat(F.lit(f"  {n} = {{"), v, F.lit("},"))) for n, v in fields)), lambda x: x.isNotNull())
    return F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.array_join(lines, "\n"), F.lit("\n}\n"))


def arxiv_bibtex(found: DataFrame, key: Column | None = None, accessed_at: str | None = None, normal: bool = True) -> DataFrame:
    """found with bibtex: the entry that stands in for an export where a preprint is all there is."""
    key = default_key(normal) if key is None else F.coalesce(key, default_key(normal))
    said = lambda k: F.try_element_at("raw", F.lit(k))
    number = first_present(F.col("c_arxiv_id"), said("arxiv_id"))
    note = F.concat_ws(", ", F.concat(F.lit("arXiv version "), said("arxiv_version")), F.concat(F.lit("accessed "), F.coalesce(said("accessed_at"), F.lit(accessed_at))))
    fields = [
        ("title", F.col("c_title")), ("author", F.array_join("c_authors", " and ")), ("year", F.col("c_year").cast("string")), ("eprint", number), ("archivePrefix", F.lit("arXiv")),
        ("url", first_present(F.col("c_url"), F.concat(F.lit("https://arxiv.org/abs/"), F.coalesce(number, F.lit(""))))), ("primaryClass", said("primary_category")), ("note", note),
    ]
    found = found.withColumns({"_key": key, "_raw": entry_text(key, [(n, bibtex_value(v)) for n, v in fields])})
    return found.withColumn("bibtex", bibtex_record(F.col("_raw"), "arxiv_manual_normalized", F.col("_key"))).drop("_key", "_raw")


def manual_bibtex(found: DataFrame, key: Column, kind: str = "publisher_metadata_manual_normalized") -> DataFrame:
    """found with bibtex: an entry written from a publisher's record."""
    fields = [("title", F.col("c_title")), ("author", F.array_join("c_authors", " and ")), ("year", F.col("c_year").cast("string")), ("howpublished", F.col("c_venue")), ("doi", F.col("c_doi")), ("url", F.col("c_url"))]
    # title and author stand even if they are empty
    lines = [F.concat(F.lit(f"  {n} = {{"), F.coalesce(v, F.lit("")), F.lit("},")) for n, v in fields[:2]] + [F.when(present(v), F.concat(F.lit(f"  {n} = {{"), v, F.lit("},"))) for n, v in fields[2:]]
    text = F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n}\n"))
    found = found.withColumn("_raw", text)
    sha = sha256(F.col("_raw"))
    record = F.struct(F.lit("misc").alias("entry_type"), key.alias("citation_key"), F.lit(kind).alias("source_kind"), F.col("_raw").alias("raw_text"), sha.alias("raw_sha256"), sha.alias("normalized_sha256"))
    return found.withColumn("bibtex", record).drop("_raw")


def export_checks(rows: DataFrame, normal: bool = True) -> DataFrame:
    """rows with title_check, doi_check and issues (codes) of an official export against the record it belongs to.

    rows: b_title, b_doi of the export, expected_title, c_doi.
    """
    same = normalize_title(F.coalesce("b_title", F.lit("")), normal) == normalize_title(F.coalesce("expected_title", F.lit("")), normal)
    b, c = present(F.col("b_doi")), present(F.col("c_doi"))
    doi = F.when(b & c, F.when(F.lower("b_doi") == F.lower("c_doi"), "exact_match").otherwise("mismatch")).when(c, "missing_in_bibtex").when(b, "authority_doi_missing").otherwise("not_checked")
    rows = rows.withColumns({"title_check": F.when(present(F.col("b_title")) & same, "exact_normalized_match").otherwise("mismatch"), "doi_check": doi})
    found = F.array(F.when(F.col("title_check") == "mismatch", F.lit("OFFICIAL_BIBTEX_TITLE_MISMATCH")), F.when(F.col("doi_check") == "mismatch", F.lit("OFFICIAL_BIBTEX_DOI_MISMATCH")))
    return rows.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))


def lookup_url(source: str, title: Column, doi: Column, arxiv: Column) -> Column:
    """Where a source is asked for a query."""
    coded = lambda c: F.url_encode(c)
    strict = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    path = lambda c: F.replace(strict(c), F.lit("%2F"), F.lit("/"))
    if source == "crossref":
        base = F.lit("https://api.crossref.org/works")
        return F.when(present(doi), F.concat(base, F.lit("/"), path(doi))).otherwise(F.concat(base, F.lit("?query.title="), coded(title), F.lit("&rows=5")))
    if source == "openalex":
        base = F.lit("https://api.openalex.org/works?")
        return F.when(present(doi), F.concat(base, F.lit("filter="), coded(F.concat(F.lit("doi:"), doi)))).otherwise(F.concat(base, F.lit("search="), coded(title), F.lit("&per-page=5")))
    if source == "semantic_scholar":
        return F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/search?query="), coded(title), F.lit("&limit=5&fields=" + "%2C".join(["paperId", "title", "authors", "year", "venue", "externalIds", "url"])))
    if source == "arxiv":
        base = F.lit("https://export.arxiv.org/api/query?")
        number, version = arxiv_parts(arxiv)
        by_title = F.concat(base, F.lit("search_query="), path(F.concat(F.lit('ti:"'), title, F.lit('"'))), F.lit("&start=0&max_results=10"))
        return F.when(present(arxiv), F.concat(base, F.lit("id_list="), coded(F.concat(number, F.coalesce(version, F.lit("")))), F.lit("&start=0&max_results=1"))).otherwise(by_title)
    raise ValueError(f"{source} is looked up by its record pages")


def with_parameter(url: Column, name: str, value: str | None) -> Column:
    """An address with a parameter, unless it has it or there is no value."""
    if not value:
        return url
    more = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), F.url_encode(F.lit(value)))
    return F.when(F.regexp_like(url, F.lit(rf"[?&]{name}=")), url).otherwise(more)


