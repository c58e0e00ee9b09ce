"""Whether a source's first page bears the expected title, and where a record's PDF and monitor lookups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.constants import MONITOR_SOURCES, PASSING_LOCK_STATUSES, PDF_HOSTS, SENSITIVE_TERMS, TITLE_DECISIONS
from provlake.functions.text import arxiv_pdf, lines_of, normalize_title, or_none, present, squeezed, strip, unicode_form, unicode_forms

LINES, SPAN, FIRST_PAGE = 8, 4, 4000
# What a title line doesn't begin with.
NO_TITLE = ["[page ", "abstract", "arxiv:", "doi:", "preprint", "proceedings of", "published as a conference paper", "under review as a conference paper"]
# What a title line doesn't hold.
BOILERPLATE = ["provided proper attribution", "google hereby grants permission", "reproduce the tables and figures", "solely for use in journalistic", "scholarly works"]


def lines(text: Column) -> Column:
    """The first lines of the first page that may be a title's."""
    mark = r"(?imsd)^\[page\s+1\]\s*(.*?)(?=^\[page\s+\d+\]|\z)"
    page = F.when(F.regexp_like(text, F.lit(r"(?imd)^\[page\s+1\]")), F.regexp_extract(text, mark, 1)).otherwise(F.substring(text, 1, FIRST_PAGE))
    some = F.transform(lines_of(page), squeezed)

    def fits(x: Column) -> Column:
        low = F.lower(x)
        ok = x != ""
        for s in NO_TITLE:
            ok &= ~F.startswith(low, F.lit(s))
        for s in BOILERPLATE:
            ok &= ~F.contains(low, F.lit(s))
        return ok & ~((F.contains(low, F.lit("copyright")) | F.contains(x, F.lit("©"))) & F.contains(low, F.lit("association for computational linguistics")))

    good = F.filter(some, fits)
    # a short line counts only after another, and as words
    first = F.array_position(F.transform(good, lambda x: F.length(x) >= 8), F.lit(True))
    later = F.filter(good, lambda x, i: (F.length(x) >= 8) | ((i + 1 > first) & (first > 0) & F.regexp_like(x, F.lit("[A-Za-z]")) & ~F.regexp_like(x, F.lit(r"[@\d]"))))
    return F.slice(later, 1, LINES)


def candidates(ls: Column) -> Column:
    """Runs of one to four of the lines, in order, each once. ls is a column of ``lines``, which is used many times."""
    n = F.size(ls)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SPAN), n - i + 1)), lambda k: F.array_join(F.slice(ls, i, k), " "))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def compact(title: Column, nfkc: bool = True) -> Column:
    t = F.replace(F.regexp_replace(normalize_title(title, nfkc), r"\\tau\b", "tau"), F.lit("τ"), F.lit("tau"))
    return F.regexp_replace(t, "[^a-z0-9]", "")


def matches(expected: Column, found: Column, nfkc: bool = True) -> Column:
    """Whether one of the found titles is the expected one: equal, or one holds the other in compact form.

    With ``nfkc`` the texts must be normal already inside arrays, where no UDF can run; pass False and normalise before.
    """
    e, c = normalize_title(expected, nfkc), compact(expected, nfkc)

    def same(x: Column) -> Column:
        k = compact(x, False)
        both = (c != "") & (k != "")
        return (normalize_title(x, False) == e) | (both & (F.contains(k, c) | ((F.length(k) >= F.least(F.lit(32), F.length(c))) & F.contains(c, k))))

    return (e == "") | F.exists(found, same)


def check(source_map: DataFrame, lock: DataFrame, texts: DataFrame, reviews: DataFrame | None = None, normal: bool = True) -> DataFrame:
    """One row for each key and source: ok, code (of what is wrong, or of the review that takes it), path_mismatch, candidate, expected_title.

    source_map: citation_key, source_text (path), source_text_raw, source_label, ord, of which the first of a key and path
    counts; lock: citation_key, title; texts: path, text (null: can't be read); reviews: citation_key, ord, decision,
    expected_title, source_title, source_text (a path or name; empty: of any). A review stands for a title that differs if
    it was accepted, and names both titles as they are; one that names another source is told, but doesn't stand for it.
    """
    first = source_map.groupBy("citation_key", "source_text").agg(F.min_by(F.struct("source_text_raw", "source_label", "ord"), "ord").alias("x")).select("citation_key", "source_text", "x.*")
    # normal forms are made before the joins, as lambdas can't hold them
    known = lock.select("citation_key", F.coalesce("title", F.lit("")).alias("expected_title"), F.lit(True).alias("_known"))
    known = known.withColumn("_title", unicode_form("NFKC")("expected_title") if normal else F.col("expected_title"))
    read = texts.select(F.col("path").alias("source_text"), lines(F.col("text")).alias("_lines")).withColumn("found", candidates(F.col("_lines"))).drop("_lines")
    read = read.withColumn("_found", unicode_forms("NFKC")("found") if normal else F.col("found"))
    j = first.join(known, "citation_key", "left").join(read, "source_text", "left")
    fits = matches(F.col("_title"), F.col("_found"), False)
    code = (
        F.when(F.col("_known").isNull(), "SOURCE_TITLE_LOCK_ENTRY_MISSING")
        .when(~present(F.col("expected_title")), "SOURCE_TITLE_EXPECTED_TITLE_MISSING")
        .when(F.col("found").isNull(), "SOURCE_TITLE_READ_FAILED")
        .when(F.size("found") == 0, "SOURCE_TITLE_CANDIDATE_MISSING")
        .when(~fits, "SOURCE_TITLE_MISMATCH")
    )
    j = j.withColumn("code", code)
    if reviews is None:
        j = j.withColumns({"_reviewed": F.lit(None).cast("int"), "_elsewhere": F.lit(None).cast("int")})
    else:
        form = unicode_form("NFKC") if normal else (lambda c: F.col(c))
        r = reviews.select("citation_key", F.col("ord").alias("_r"), F.lower(strip(F.coalesce("decision", F.lit("")))).alias("_decision"), strip(F.coalesce("expected_title", F.lit(""))).alias("_e"), strip(F.coalesce("source_title", F.lit(""))).alias("_s"), strip(F.coalesce("source_text", F.lit(""))).alias("_p"))
        r = r.where(F.col("_decision").isin(TITLE_DECISIONS) & (F.col("_e") != "") & (F.col("_s") != "")).withColumns({"_e": form("_e"), "_s": form("_s")})
        m = j.where("code = 'SOURCE_TITLE_MISMATCH'").join(r, "citation_key")
        title, short = normalize_title(F.col("_s"), False), compact(F.col("_s"), False)
        same = (title != "") & F.exists("_found", lambda x: (normalize_title(x, False) == title) | ((short != "") & (compact(x, False) == short)))
        m = m.where((normalize_title(F.col("_e"), False) == normalize_title(F.col("_title"), False)) & same)
        places = F.array("source_text", "source_text_raw", "source_label", F.regexp_extract("source_text", r"([^/]*)$", 1))
        here = (F.col("_p") == "") | F.exists(places, lambda x: present(x) & (plain_path(x) == plain_path(F.col("_p")))) | (plain_path(F.concat(F.regexp_replace("source_text", r"[^/]*$", ""), F.col("_p"))) == plain_path(F.col("source_text")))
        told = m.groupBy("citation_key", "source_text").agg(F.min(F.when(here, F.col("_r"))).alias("_reviewed"), F.min(F.when(~here, F.col("_r"))).alias("_elsewhere"))
        j = j.join(told, ["citation_key", "source_text"], "left")
    taken = F.col("_reviewed").isNotNull()
    code = F.when(taken, "SOURCE_TITLE_MISMATCH_REVIEWED").otherwise(F.col("code"))
    return j.select("citation_key", "source_text", "source_label", "ord", (F.col("code").isNull() | taken).alias("ok"), code.alias("code"), (~taken & F.col("_elsewhere").isNotNull()).alias("path_mismatch"), F.get("found", F.lit(0)).alias("candidate"), "expected_title")


def plain_path(c: Column) -> Column:
    """A path without what changes nothing in it: doubled strokes, single dots, and folders that two dots leave again."""
    out = F.regexp_replace(F.regexp_replace(c, "/+", "/"), r"(?:(?<=^)|(?<=/))\./", "")
    for _ in range(4):
        out = F.regexp_replace(out, r"(?:(?<=^)|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    return out


def title_issues(checked: DataFrame) -> DataFrame:
    """code, severity, citation_key, evidence of ``check``: what blocks, and what a review has taken or missed."""
    told = F.array(F.concat(F.lit("expected: "), "expected_title"), F.concat(F.lit("source candidate: "), "candidate"), F.col("source_text"))
    own = F.when(F.col("code").isin("SOURCE_TITLE_MISMATCH", "SOURCE_TITLE_MISMATCH_REVIEWED"), told).otherwise(F.array("source_text"))
    one = F.when(F.col("code").isNotNull(), F.struct(F.col("code"), F.when(F.col("ok"), "warning").otherwise("blocking").alias("severity"), own.alias("evidence")))
    two = F.when(F.col("path_mismatch"), F.struct(F.lit("SOURCE_TITLE_REVIEW_PATH_MISMATCH").alias("code"), F.lit("warning").alias("severity"), F.array("source_text").alias("evidence")))
    return checked.select("citation_key", "ord", F.explode(F.filter(F.array(two, one), lambda x: x.isNotNull())).alias("x")).select("x.code", "x.severity", "citation_key", "x.evidence", "ord")


def validated(texts: DataFrame, min_chars: int = 80) -> DataFrame:
    """path, kind, char_count, page_marker_count, ok, code of source texts (path, text; null: can't be read)."""
    n = F.length(strip(F.col("text")))
    code = F.when(F.col("text").isNull(), "SOURCE_TEXT_READ_FAILED").when(n < min_chars, "SOURCE_TEXT_TOO_SHORT")
    marks = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?im)^\[page\s+[^\]]+\]"), F.lit(0)))
    return texts.select("path", F.when(F.endswith(F.lower("path"), F.lit(".pdf")), "pdf").otherwise("text").alias("kind"), F.coalesce(n, F.lit(0)).cast("long").alias("char_count"), marks.cast("long").alias("page_marker_count"), code.isNull().alias("ok"), code.alias("code"))


#: Folders and files that a hygiene scan leaves out, or names as made by tools.
SKIPPED = r"(?:^|/)(?:\.git|\.venv|__pycache__|\.pytest_cache|dist|build)(?:/|$)"
MADE = r"(?:\.pyc|\.pyo|\.egg-info)$"
#: Lines that may hold a term: the place's end, the term, the line.
ALLOWED = [(".github/workflows/release.yml", "token", "id-token: write")]


def hygiene(files: DataFrame) -> DataFrame:
    """path, match: sensitive terms in files (path, text; null: no text), a row for each of a file's."""
    held = F.coalesce("text", F.lit(""))

    def has(term: str) -> Column:
        text = held
        for place, t, line in ALLOWED:
            if t == term:
                text = F.when(F.endswith("path", F.lit(place)), F.replace(held, F.lit(line), F.lit(""))).otherwise(text)
        return F.when(F.contains(text, F.lit(term)), F.lit(term))

    kept = files.where(~F.regexp_like("path", F.lit(SKIPPED)) & ~F.regexp_like("path", F.lit(MADE)))
    return kept.select("path", F.explode(F.filter(F.array(*map(has, SENSITIVE_TERMS)), lambda x: x.isNotNull())).alias("match"))


def made_by_tools(files: DataFrame) -> DataFrame:
    """path of files that belong in no release."""
    return files.where(F.regexp_like("path", F.lit(MADE)) & ~F.regexp_like("path", F.lit(SKIPPED))).select("path")


# --- records that are still to come, and where PDFs are ----------------------------------------------


def needs_monitor(lock: DataFrame) -> DataFrame:
    """Lock entries (status, source_kind, authority) for which an official record may still come."""
    kind = F.coalesce("source_kind", F.lit(""))
    return lock.where(F.coalesce(F.col("status").isin("arxiv_fallback_verified", "official_record_pending"), F.lit(False)) | (kind == "arxiv_manual_normalized") | (F.coalesce("authority", F.lit("")) == "arxiv"))


def monitor_sources(recommended: Column, requested: list[str] | None = None) -> Column:
    """Where official records are looked for: those asked for, or those recommended and Crossref."""
    if requested:
        return F.array(*(F.lit(s) for s in requested if s in MONITOR_SOURCES))
    own = F.filter(recommended, lambda s: s.isin(MONITOR_SOURCES))
    return F.when(F.array_contains(own, "crossref"), own).otherwise(F.array_append(own, F.lit("crossref")))


def unverified(lock: DataFrame) -> DataFrame:
    return lock.where(~F.coalesce(F.col("status").isin(PASSING_LOCK_STATUSES), F.lit(False)))


PAPER = [("/hash/", "/file/"), (r"-Abstract(?=[-.])", "-Paper"), (r"\.html(?:[?#].*)?$", ".pdf")]
# Record pages and the PDF that belongs to each, in order: source, what the address holds, what is changed
# in it. Of several changes all are made; an address that none changes has no PDF by this rule.
PDF_RULES = [
    ("acl", r"(?i)^https://aclanthology\.org/[^?#/]+/?(?:[?#].*)?$", [(r"^([^?#]*?)/?(?:[?#].*)?$", "$1.pdf")]),
    ("neurips", r"proceedings\.neurips\.cc", [(r"(proceedings\.neurips\.cc)/paper/", "$1/paper_files/paper/"), *PAPER]),
    ("iclr", r"proceedings\.iclr\.cc", PAPER),
    ("openreview", r"(?i)^[a-z]+://openreview\.net/(?:pdf|forum)/*\?(?:[^#]*&)?id=[^&#\s]", [(r"(?i)^.*?[?&]id=([^&#]+).*$", "https://openreview.net/pdf?id=$1")]),
    ("pmlr", r"proceedings\.mlr\.press", [(r"\.html(?:[?#].*)?$", ".pdf")]),
    ("acm", r"(?i)^https://dl\.acm\.org/doi/.", [(r"(?i)^(https://dl\.acm\.org)/doi/(?:abs/|pdf/)?(.+?)(?:[?#].*)?$", "$1/doi/pdf/$2")]),
    ("cvf", r"openaccess\.thecvf\.com", [("/html/", "/papers/"), (r"\.html(?:[?#].*)?$", ".pdf")]),
    ("jmlr", r"jmlr\.org", [(r"(?i)^(https?://(?:www\.)?jmlr\.org)/papers/v(\d+)/([^/?#]+)\.html(?:[?#].*)?$", "$1/papers/volume$2/$3/$3.pdf"), (r"\.html(?:[?#].*)?$", ".pdf")]),
    ("springer", r"(?i)^https://link\.springer\.com/(?:chapter|article)/.", [(r"(?i)^(https://link\.springer\.com)/(?:chapter|article)/(.+?)(?:[?#].*)?$", "$1/content/pdf/$2.pdf")]),
    ("pnas", r"(?i)^https://(?:www\.)?pnas\.org/doi/(?:abs|full|pdf)/.", [(r"(?i)^(https://(?:www\.)?pnas\.org)/doi/(?:abs|full|pdf)/(.+?)(?:[?#].*)?$", "$1/doi/pdf/$2")]),
    ("science", r"(?i)^https://www\.science\.org/doi/(?:abs|full|pdf)/.", [(r"(?i)^(https://www\.science\.org)/doi/(?:abs|full|pdf)/(.+?)(?:[?#].*)?$", "$1/doi/pdf/$2")]),
    ("frontiers", r"frontiersin\.org", [(r"/full(?:[?#].*)?$", "/pdf")]),
    ("mdpi", r"mdpi\.com", [(r"^(.*?)(?:/htm)?/*(?:[?#].*)?$", "$1/pdf")]),
]
#: Rules by which an address that is a PDF's already, without saying so at its end, stays.
STAYS = {"frontiers": r"(?i)/pdf$", "mdpi": r"(?i)/pdf$", "openreview": None, "acm": None, "pnas": None, "science": None}


def pdf_source(url: Column, fallback: Column) -> Column:
    """What source a PDF's address speaks for."""
    low = F.lower(url)
    return F.coalesce(*(F.when(F.contains(low, F.lit(h)), F.lit(s)) for h, s in PDF_HOSTS), fallback)


def pdf_of(url: Column, authority: Column | None = None) -> Column:
    """struct(url, source) of the PDF that an address leads to; null if no rule knows."""
    both = lambda u, s: F.when(present(u), F.struct(u.alias("url"), s.alias("source")))
    own = F.lit(None).cast("string") if authority is None else or_none(authority)
    found = [F.when(F.endswith(F.lower(url), F.lit(".pdf")), both(url, pdf_source(url, F.coalesce(own, F.lit("direct_pdf")))))]
    number = F.regexp_replace(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|html|pdf)/([^?#/]+)", 1), r"\.pdf$", "")
    found.append(both(arxiv_pdf(number), F.lit("arxiv")))
    for source, holds, steps in PDF_RULES:
        changed = url
        for p, r in steps:
            changed = F.regexp_replace(changed, p, r)
        stays = STAYS.get(source)
        same = F.regexp_like(url, F.lit(stays)) if stays else F.lit(source in STAYS)
        new = F.when(same, url if stays else changed).when(changed != url, changed)
        found.append(F.when(F.regexp_like(url, F.lit(holds)), both(new, F.lit(source))))
    return F.coalesce(*found)


def pdf_url(*urls: Column) -> Column:
    """The PDF of the first address that one of the rules knows."""
    return F.coalesce(*(pdf_of(u)["url"] for u in urls))


def download_plan(lock: DataFrame, folder: str, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, issues): citation_key, url, source, output, status, reason of each entry's PDF; what has none, and what was asked for in vain.

    lock: entries with record, authority and bibtex; keys: citation_key of those asked for.
    """
    text = F.coalesce("bibtex.canonical_text", F.lit(""))
    own = or_none(strip(F.regexp_replace(F.regexp_extract(text, r"(?is)[,\s]url\s*=\s*(\{[^{}]*\}|\"[^\"]*\")", 1), r"^[{\"]|[}\"]$", "")))
    source = F.coalesce(F.col("authority.source"), F.lit(""))
    found = F.coalesce(*(pdf_of(u, source) for u in (own, F.col("record.url"), F.col("authority.record_url"), F.col("authority.bibtex_url"))), F.when(present(arxiv_pdf(F.col("record.arxiv_id"))), F.struct(arxiv_pdf(F.col("record.arxiv_id")).alias("url"), F.lit("arxiv").alias("source"))))
    some = lock if keys is None else lock.join(keys.select("citation_key").distinct(), "citation_key", "left_semi")
    rows = some.select("citation_key", found.alias("x"), source.alias("_s"))
    items = rows.select(
        "citation_key", "x.url", F.coalesce("x.source", or_none(F.col("_s"))).alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), "citation_key", F.lit(".pdf")).alias("output"),
        F.when(F.col("x").isNull(), "missing_url").otherwise("planned").alias("status"), F.when(F.col("x").isNull(), "no_download_url").alias("reason"),
    )
    told = items.where("url is null").select(F.lit("SOURCE_DOWNLOAD_URL_MISSING").alias("code"), F.lit("warning").alias("severity"), "citation_key")
    if keys is not None:
        vain = keys.select("citation_key").distinct().join(lock.select("citation_key"), "citation_key", "left_anti")
        told = told.unionByName(vain.select(F.lit("SOURCE_DOWNLOAD_LOCK_ENTRY_MISSING").alias("code"), F.lit("warning").alias("severity"), "citation_key"))
    return items, told


def failure_code(error: Column) -> Column:
    """A failed lookup's code by what its error says, first match."""
    e = F.coalesce(error, F.lit(""))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(e, w))
    return (
        F.when(e == "", "NO_CANDIDATES")
        .when(has("HTTP Error 429", " 429"), "LIVE_SMOKE_RATE_LIMITED")
        .when(has("URLError", "nodename nor servname", "Name or service not known"), "LIVE_SMOKE_NETWORK_UNAVAILABLE")
        .when(has("HTTPError"), "LIVE_SMOKE_HTTP_ERROR")
        .otherwise("LIVE_SMOKE_DISCOVERY_ERROR")
    )


def failure_message(code: Column, source: Column) -> Column:
    return (
        F.when(code == "LIVE_SMOKE_RATE_LIMITED", F.concat(source, F.lit(" live endpoint rate-limited the request.")))
        .when(code == "LIVE_SMOKE_NETWORK_UNAVAILABLE", "Network resolution failed before the live endpoint could be checked.")
        .when(code == "NO_CANDIDATES", F.concat(source, F.lit(" live lookup returned no candidates for the query.")))
        .when(code == "LIVE_SMOKE_HTTP_ERROR", F.concat(source, F.lit(" live endpoint returned an HTTP error.")))
        .otherwise(F.concat(source, F.lit(" live lookup failed before producing candidates.")))
    )
