"""Follow-up actions: rules that issues and states set off, their gates, plans and roll-ups.

An action is a row: code, kind, citation_key, requires_human_review, writes_files, network_required, message, command,
and what some rules add: missing_inputs, input_options, preferred_input, official_bibtex_url, keys (a sample), more_commands
(by name). Nothing here runs a command.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import or_none, present, shell_quoted
from provlake.operators.rollup import SAMPLE, first_seen
from provlake.operators.titles import failure_code

PROGRAM = "python -m provlake"

# Actions: kind, needs a person, writes files, needs the network, message.
ACTIONS = {
    "ADD_REFERENCE_CANDIDATES": ("reference_candidate_input", True, True, False, "Add reviewed candidate records for this citation key, or rerun reference-check with --live."),
    "REVIEW_REFERENCE_CANDIDATE": ("reference_candidate_review", True, True, False, "Review the best low-confidence or preprint-only candidate, then add a citation-key candidate file with an official venue record or an explicit reviewed fallback."),
    "RETRY_OR_CACHE_LIVE_LOOKUP": ("live_lookup", False, True, True, "Live lookup failed; inspect rate limits or retry with reviewed cache/prefer-cache."),
    "ADD_OFFICIAL_HTML_FIXTURE": ("official_html_fixture_input", True, True, False, "If the publisher blocks live lookup, save the official record HTML as citationkey.source.html or citationkey.html, then rerun reference-check with --fixture-html-dir."),
    "ADD_OFFICIAL_BIBTEX_FIXTURE": ("official_bibtex_fixture_input", True, True, False, "Official BibTeX fetch failed; save the reviewed official export as a citation-key file and rerun reference-check."),
    "FETCH_OFFICIAL_BIBTEX_EXPORT": ("official_bibtex_fetch", False, True, True, "The selected authority exposes an official BibTeX URL; fetch it before using a manual fallback."),
    "ADD_BIBTEX_PROVENANCE": ("bibtex_provenance_input", True, True, False, "Add a reviewed official BibTeX export fixture or reviewed manual fallback file before updating the lockfile."),
    "AUDIT_BIB_AFTER_REFERENCE_UPDATE": ("validation_command", False, False, False, "Lockfile provenance was updated; rerun the submission bibliography audit."),
    "SYNC_BIBTEX_AFTER_REFERENCE_UPDATE": ("bibtex_sync", False, False, False, "Lockfile provenance was updated; plan a canonical BibTeX synchronization for the manuscript bibliography."),
    "WRITE_REFERENCE_LOCK": ("lockfile_update", True, True, False, "References were selected but the lockfile was not updated; rerun with --write-lock when provenance inputs are ready."),
    "SYNC_BIBTEX": ("bibtex_sync", False, False, False, "Plan a lockfile-backed BibTeX synchronization for entries that differ from canonical provenance."),
    "RESOLVE_REFERENCE_PROVENANCE": ("reference_provenance", True, True, False, "Resolve unresolved bibliography entries, then run discovery/reference-check with reviewed candidates."),
    "MAP_CLAIM_SOURCES": ("claim_source_mapping", True, True, False, "Add full source text/PDF files named by citation key, then rerun paper-audit with source mapping."),
    "ADD_MISSING_SOURCE_FILES": ("claim_source_mapping", True, True, False, "Add source text/PDF files for citation keys that have claims but no mapped source."),
    "REVIEW_NO_MATCH_CLAIMS": ("claim_evidence_review", True, False, False, "Open the claim review report and inspect mapped sources that did not contain a matching evidence block."),
    "EXPORT_REVIEW_BUNDLE": ("claim_review_bundle", False, True, False, "Export a claim review bundle with source candidates; a review of it is read back with import-review."),
    "REVIEW_CLAIM_EVIDENCE": ("claim_evidence_review", True, False, False, "Review suggested evidence spans, then mark supported claims checked or rewrite/delete unsupported claims."),
    "EXPORT_HANDOFF": ("handoff_export", False, True, False, "Audit passed; export a standalone handoff artifact if this manuscript is ready to share."),
    "REVIEW_SOURCE_TITLE_MISMATCH": ("source_integrity_review", True, False, False, "Review mapped source files whose first-page title does not match the lockfile title; replace the source file or repair the lock/BibTeX only after official provenance review."),
    "RETRY_LIVE_SMOKE_RATE_LIMITED": ("live_smoke_retry", False, True, True, "Endpoint rate limit blocked this live check. Retry this citation separately with slower backoff and cache preference before preserving a reviewed manifest."),
    "RETRY_LIVE_SMOKE_AFTER_NETWORK_AVAILABLE": ("live_smoke_retry", False, True, True, "Network resolution failed. Do not mark the reference externally verified; rerun when network access is available."),
    "REVIEW_LIVE_SMOKE_NO_CANDIDATES": ("live_smoke_review", False, False, False, "No live candidate matched. Check the title, DOI, arXiv ID, or official URL before trying another source or adding a reviewed fixture."),
    "RETRY_LIVE_SMOKE_DISCOVERY": ("live_smoke_retry", False, True, True, "Live discovery failed. Inspect the endpoint error before treating this reference as externally verified."),
    "WRITE_SYNCED_BIBTEX": ("bibtex_sync_write", False, True, False, "Write the planned BibTeX synchronization to an output file."),
    "REFRESH_LOCK_CANONICAL_BIBTEX": ("lockfile_reference_refresh", False, True, True, "Refresh official-export lock entries so sync-bibtex has canonical BibTeX text."),
    "BACKFILL_MANUAL_CANONICAL_BIBTEX": ("lockfile_reference_refresh", True, True, False, "Add reviewed fallback BibTeX files and refresh lock entries so sync-bibtex has canonical text."),
    "DOWNLOAD_SOURCES_LIVE": ("source_download", False, True, True, "Run the same command with --live to download planned source PDFs."),
    "CHECK_OFFICIAL_RECORD": ("live_reference_check", False, False, True, ""),
}
# Which issues of a reference check set off which actions, in order.
REFERENCE_RULES = [
    ("REFERENCE_CANDIDATES_MISSING", ["ADD_REFERENCE_CANDIDATES"]),
    ("NO_CANDIDATES", ["ADD_REFERENCE_CANDIDATES"]),
    ("LOW_CONFIDENCE", ["REVIEW_REFERENCE_CANDIDATE"]),
    ("OFFICIAL_RECORD_PENDING", ["REVIEW_REFERENCE_CANDIDATE"]),
    ("REFERENCE_LIVE_LOOKUP_FAILED", ["RETRY_OR_CACHE_LIVE_LOOKUP", "ADD_OFFICIAL_HTML_FIXTURE"]),
    ("OFFICIAL_BIBTEX_FETCH_FAILED", ["ADD_OFFICIAL_BIBTEX_FIXTURE"]),
    ("BIBTEX_PROVENANCE_INPUT_MISSING", ["FETCH_OFFICIAL_BIBTEX_EXPORT", "ADD_BIBTEX_PROVENANCE"]),
]
# What a failed lookup's code sets off; retries of a rate limit: interval, tries, wait.
LOOKUP_RULES = {
    "LIVE_SMOKE_RATE_LIMITED": "RETRY_LIVE_SMOKE_RATE_LIMITED",
    "LIVE_SMOKE_NETWORK_UNAVAILABLE": "RETRY_LIVE_SMOKE_AFTER_NETWORK_AVAILABLE",
    "NO_CANDIDATES": "REVIEW_LIVE_SMOKE_NO_CANDIDATES",
}
RETRY_ARXIV, RETRY = (30, 3, 60), (5, 2, 10)


def command(*parts: str | Column) -> Column:
    """A command line of the program; parts that are null are left out."""
    return F.concat_ws(" ", F.lit(PROGRAM), *(shell_quoted(p if isinstance(p, Column) else F.lit(p)) for p in parts))


def flags(**options: str | Column | bool | int | list | None) -> list[str | Column]:
    """Options of a command in order; False and None are left out, a list repeats its option, a null column leaves it out."""
    out: list[str | Column] = []
    for name, v in options.items():
        flag = "--" + name.replace("_", "-")
        if isinstance(v, Column):
            out += [F.when(present(v), F.lit(flag)), or_none(v)]
        elif v is True:
            out.append(flag)
        elif isinstance(v, list):
            out += [x for one in v for x in (flag, str(one))]
        elif v not in (None, False, ""):
            out += [flag, str(v)]
    return out


def acted(code: Column) -> list[Column]:
    """kind, flags and message of an action's code."""
    table = F.create_map(*(x for c, (kind, human, writes, network, message) in ACTIONS.items() for x in (F.lit(c), F.struct(F.lit(kind).alias("kind"), F.lit(human).alias("requires_human_review"), F.lit(writes).alias("writes_files"), F.lit(network).alias("network_required"), F.lit(message).alias("message")))))
    one = F.try_element_at(table, code)
    return [one[f].alias(f) for f in ("kind", "requires_human_review", "writes_files", "network_required", "message")]


def reference_actions(issues: DataFrame, decisions: DataFrame, lock: str, options: dict | None = None, updated: int = 0, write_lock: str | None = None) -> DataFrame:
    """Actions that the blocking issues of a reference check set off, then those of its state; of equal code and key the first.

    issues: ord, code, citation_key; decisions: citation_key, decision, authority. options: what the check was run with
    (candidate_dir, bibtex_dir, official_bibtex_dir, fixture_html_dir, source, cache_root, prefer_cache, fallback_reason,
    max_entries, citation_key, fetch_official_bibtex, live); updated: entries that it has written.
    """
    o = dict(options or {})
    spark = issues.sparkSession
    rules = F.create_map(*(x for code, actions in REFERENCE_RULES for x in (F.lit(code), F.array(*map(F.lit, actions)))))
    rows = issues.select("ord", "code", "citation_key").join(decisions.select("citation_key", F.col("authority.bibtex_url").alias("_url"), F.col("authority.source").alias("_source")), "citation_key", "left")
    rows = rows.withColumn("issue", F.col("code")).select("ord", "issue", "citation_key", "_url", "_source", F.posexplode(F.try_element_at(rules, F.col("issue"))).alias("pos", "code"))
    rows = rows.where((F.col("code") != "FETCH_OFFICIAL_BIBTEX_EXPORT") | (present(F.col("_url")) & F.lit(not o.get("fetch_official_bibtex"))))

    def rerun(key: Column | None = None, **changes) -> Column:
        own = o | changes
        names = ["candidate_dir", "bibtex_dir", "official_bibtex_dir", "fixture_html_dir", "source", "cache_root", "prefer_cache", "write_lock", "fallback_reason", "max_entries", "citation_key", "fetch_official_bibtex", "live"]
        own = {n: own.get(n) for n in names} | {"write_lock": changes.get("write_lock", write_lock)}
        if key is not None and not own["citation_key"]:
            own["citation_key"] = key
        return command("reference-check", "--lock", lock, *flags(**own, json=True))

    key = F.col("citation_key")
    reason = o.get("fallback_reason") or "Reviewed saved official HTML; manual BibTeX fallback retained because no official BibTeX endpoint was verified."
    told = F.when(
        F.col("code").isin("ADD_REFERENCE_CANDIDATES", "REVIEW_REFERENCE_CANDIDATE"), rerun(candidate_dir=o.get("candidate_dir") or "REFERENCE_CANDIDATES_DIR")
    )
    told = told.when(F.col("code") == "RETRY_OR_CACHE_LIVE_LOOKUP", rerun(live=True, prefer_cache=True))
    told = told.when(F.col("code") == "ADD_OFFICIAL_HTML_FIXTURE", rerun(key, bibtex_dir=o.get("bibtex_dir") or "REVIEWED_FALLBACK_BIBTEX_DIR", fixture_html_dir="OFFICIAL_HTML_DIR", live=False, fallback_reason=reason))
    told = told.when(F.col("code") == "ADD_OFFICIAL_BIBTEX_FIXTURE", rerun(key, official_bibtex_dir=o.get("official_bibtex_dir") or "OFFICIAL_BIBTEX_DIR", live=False))
    told = told.when(F.col("code") == "FETCH_OFFICIAL_BIBTEX_EXPORT", rerun(key, fetch_official_bibtex=True))
    told = told.when(F.col("code") == "ADD_BIBTEX_PROVENANCE", rerun(bibtex_dir=o.get("bibtex_dir") or "REVIEWED_FALLBACK_BIBTEX_DIR", official_bibtex_dir=o.get("official_bibtex_dir") or "OFFICIAL_BIBTEX_DIR"))
    more = F.col("code") == "ADD_BIBTEX_PROVENANCE"
    fixture = o.get("official_bibtex_dir") or "OFFICIAL_BIBTEX_DIR"
    manual = o.get("bibtex_dir") or "REVIEWED_FALLBACK_BIBTEX_DIR"
    choice = lambda kind, folder: F.struct(F.lit(kind).alias("kind"), F.lit(folder).alias("directory"))
    rows = rows.select(
        (F.col("ord") * 10 + F.col("pos")).alias("ord"), "code", F.coalesce(key, F.lit("")).alias("citation_key"), *acted(F.col("code")), told.alias("command"),
        F.when(more, F.array(F.lit("official_bibtex_export_or_reviewed_manual_fallback"))).alias("missing_inputs"),
        F.when(more, F.array(choice("official_bibtex_export_fixture", fixture), choice("reviewed_manual_fallback", manual))).alias("input_options"),
        F.when(more, F.when(present(F.col("_url")), "official_bibtex_export").otherwise("reviewed_manual_fallback_or_official_fixture")).alias("preferred_input"),
        F.when(F.col("code").isin("FETCH_OFFICIAL_BIBTEX_EXPORT", "ADD_BIBTEX_PROVENANCE", "ADD_OFFICIAL_BIBTEX_FIXTURE"), F.col("_url")).alias("official_bibtex_url"),
        F.when(present(F.col("_source")), F.col("_source")).alias("source"),
    )
    last = 1 << 40
    state = []
    target = write_lock or lock
    if updated:
        state.append(("AUDIT_BIB_AFTER_REFERENCE_UPDATE", command("audit-bib", "--bib", "PAPER_BIB", "--lock", target, "--submission", "--json")))
        state.append(("SYNC_BIBTEX_AFTER_REFERENCE_UPDATE", command("sync-bibtex", "--bib", "PAPER_BIB", "--lock", target, "--json")))
    for i, (code, told) in enumerate(state):
        one = spark.range(1).select(F.lit(last + i).alias("ord"), F.lit(code).alias("code"), F.lit("").alias("citation_key"), *acted(F.lit(code)), told.alias("command"))
        rows = rows.unionByName(one, allowMissingColumns=True)
    if not updated and write_lock is None:
        # one row if something was selected and nothing blocks
        any_ = decisions.agg(F.count_if(F.col("decision") == "selected").alias("n")).select("n", F.lit(1).alias("_one"))
        none = issues.agg(F.count(F.lit(1)).alias("_blocking")).select("_blocking", F.lit(1).alias("_one"))
        one = any_.join(F.broadcast(none), "_one").where("n > 0 and _blocking = 0")
        code = F.lit("WRITE_REFERENCE_LOCK")
        rows = rows.unionByName(one.select(F.lit(last).alias("ord"), code.alias("code"), F.lit("").alias("citation_key"), *acted(code), rerun(write_lock=lock).alias("command")), allowMissingColumns=True)
    return first_seen(rows, ["code", "citation_key"], "ord")


def audit_actions(state: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Actions that a paper audit's state sets off, in order: one row of state for each project.

    state: project, blocking (codes), work_items, work_keys (a sample), checked (whether claims met their sources),
    missing_keys, no_match (claim ids), updated (suggestions made), handed_off. paths: tex, bib, lock, claims, and review,
    sources, source_map where there are such.
    """
    p = lambda n, other="": paths.get(n) or other
    held = F.arrays_overlap("blocking", F.array(*map(F.lit, K.CLAIM_BLOCKERS)))
    checked = F.coalesce("checked", F.lit(False))
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    review = (F.coalesce("updated", F.lit(0)) > 0) | held
    base = [*flags(tex=p("tex"), bib=p("bib"), lock=p("lock"), claims=p("claims"))]
    sample = lambda c: F.slice(F.col(c), 1, SAMPLE)
    none = F.lit(None).cast("array<string>")
    rules: list[tuple[str, Column, Column, Column]] = [
        ("SYNC_BIBTEX", F.array_contains("blocking", "OFFICIAL_EXPORT_CONTENT_CHANGED"), command("sync-bibtex", "--bib", p("bib"), "--lock", p("lock"), "--json"), none),
        ("RESOLVE_REFERENCE_PROVENANCE", F.col("work_items") > 0, command("resolver-assist", "--lock", p("lock"), "--output", p("queries", "queries.json"), "--json"), sample("work_keys")),
        ("MAP_CLAIM_SOURCES", ~checked & held, command("paper-audit", *base, *flags(source_dir="SOURCES_DIR", source_map_output=p("source_map"), claim_review_output=p("review"), json=True)), none),
        ("ADD_MISSING_SOURCE_FILES", checked & some("missing_keys"), command("paper-audit", *base, *flags(source_map=p("source_map"), source_dir=p("sources"), json=True)), sample("missing_keys")),
        ("REVIEW_NO_MATCH_CLAIMS", checked & some("no_match"), F.lit(None).cast("string"), sample("no_match")),
        ("EXPORT_REVIEW_BUNDLE", checked & review, command("export-review-bundle", *base, *flags(source_map=p("source_map"), json=True)), none),
        ("REVIEW_CLAIM_EVIDENCE", checked & review, command("claim-consistency", "--claims", p("claims"), "--submission", "--json"), none),
        ("EXPORT_HANDOFF", (F.size("blocking") == 0) & ~F.coalesce("handed_off", F.lit(False)), command("export-handoff", "--bib", p("bib"), "--lock", p("lock"), "--output", "handoff.json", "--submission", "--json"), none),
    ]
    made = F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(i).alias("ord"), told.alias("command"), keys.alias("keys"))) for i, (code, holds, told, keys) in enumerate(rules)))
    rows = state.select("project", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return rows.select("project", "x.ord", "x.code", F.lit("").alias("citation_key"), *acted(F.col("x.code")), "x.command", "x.keys")


def each_key(keys: Column) -> Column:
    """A --citation-key option for each of the keys; null if there is none."""
    return or_none(F.array_join(F.transform(keys, lambda k: F.concat(F.lit("--citation-key "), shell_quoted(k))), " "))


def sync_actions(synced: DataFrame, lock: str | Column, output: str | None = None, add_missing: bool = False, asked: list[str] | None = None, wrote: bool = False) -> DataFrame:
    """What a synchronization's plan sets off, for each bibliography: path, code, an action's columns, command.

    synced: path, ord, citation_key, action, reason, source_kind (see ``upsert.sync_action``). A plan without blocked
    entries that changes something may be written; entries without canonical text are refreshed from their official
    export, or filled in from reviewed files where their source is another. Keys stand in the order of ord.
    """
    lacking = (F.col("action") == "blocked") & (F.col("reason") == "canonical_bibtex_text_missing")
    official = F.coalesce(F.col("source_kind") == "official_export", F.lit(False))
    keys = lambda held: F.transform(F.array_sort(F.collect_list(F.when(held, F.struct("ord", "citation_key")))), lambda e: e["citation_key"])
    state = synced.groupBy("path").agg(
        F.bool_or(F.col("action") == "blocked").alias("blocked"), F.count_if(F.col("action").isin("add", "replace")).alias("changes"), keys(lacking & official).alias("official"), keys(lacking & ~official).alias("manual")
    )
    at = lock if isinstance(lock, Column) else F.lit(lock)
    own = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    rules = [
        ("WRITE_SYNCED_BIBTEX", ~F.col("blocked") & (F.col("changes") > 0) & F.lit(not wrote), F.concat_ws(" ", command("sync-bibtex", "--bib", F.col("path"), "--lock", at, "--output", output or "references.provlake.bib", *flags(add_missing=add_missing, json=True)), each_key(own))),
        ("REFRESH_LOCK_CANONICAL_BIBTEX", F.size("official") > 0, F.concat_ws(" ", command("reference-check", "--lock", at, "--write-lock", at, "--fetch-official-bibtex", "--live", "--json"), each_key(F.col("official")))),
        ("BACKFILL_MANUAL_CANONICAL_BIBTEX", F.size("manual") > 0, F.concat_ws(" ", command("reference-check", "--lock", at, "--bibtex-dir", "REVIEWED_FALLBACK_BIBTEX_DIR", "--write-lock", at, "--json"), each_key(F.col("manual")))),
    ]
    made = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), told.alias("command"))) for i, (code, holds, told) in enumerate(rules))))
    rows = state.select("path", F.explode(made).alias("x"))
    return rows.select("path", "x.ord", "x.code", F.lit("").alias("citation_key"), *acted(F.col("x.code")), "x.command")


def download_actions(items: DataFrame, source_dir: str, asked: list[str] | None = None, live: bool = False) -> DataFrame:
    """One action for each lockfile of which a download plan has an address, until it was run. items: lock, url."""
    held = items.groupBy("lock").agg(F.bool_or(present(F.col("url"))).alias("_any")).where(F.col("_any") & F.lit(not live))
    code = F.lit("DOWNLOAD_SOURCES_LIVE")
    return held.select("lock", code.alias("code"), F.lit("").alias("citation_key"), *acted(code), command("download-sources", "--lock", F.col("lock"), "--source-dir", source_dir, *flags(citation_key=asked or [], live=True, json=True)).alias("command"))


def query_flags() -> list[Column]:
    """Options that say a query: title, query_id, citation_key, year, doi, arxiv_id; authors and preferred venues follow."""
    out = []
    for flag, c in (("--title", "title"), ("--query-id", "query_id"), ("--citation-key", "citation_key"), ("--year", "year"), ("--doi", "doi"), ("--arxiv-id", "arxiv_id")):
        v = F.col(c).cast("string")
        out.append(F.when(present(v), F.concat(F.lit(flag + " "), shell_quoted(v))))

    def each(flag: str, c: str) -> Column:
        return or_none(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(flag + " "), shell_quoted(x))), " "))

    return [*out, each("--author", "authors"), each("--preferred-venue", "preferred_venues")]


def lookup_actions(results: DataFrame, cache_root: str = "cache", prefer_cache: bool = False, interval: int = 0, retry: int = 0, wait: int = 0) -> DataFrame:
    """The action that each failed lookup sets off: a retry, slower after a rate limit, or a look at the query.

    results: ord, source, ok, error, and a query's columns.
    """
    failure = failure_code(F.col("error"))
    rules = F.create_map(*(F.lit(x) for kv in LOOKUP_RULES.items() for x in kv))
    code = F.coalesce(F.try_element_at(rules, failure), F.lit("RETRY_LIVE_SMOKE_DISCOVERY"))
    limited = failure == "LIVE_SMOKE_RATE_LIMITED"

    def number(flag: str, own: int, i: int) -> Column:
        slow = F.greatest(F.lit(own), F.when(F.col("source") == "arxiv", RETRY_ARXIV[i]).otherwise(RETRY[i]))
        n = F.when(limited, slow).otherwise(F.lit(own))
        return F.when(n > 0, F.concat(F.lit(flag + " "), n.cast("string")))

    cached = F.lit(prefer_cache) | limited | (failure == "NO_CANDIDATES")
    parts = [F.lit(f"{PROGRAM} live-smoke --source"), shell_quoted(F.col("source")), *query_flags(), F.concat(F.lit("--cache-root "), shell_quoted(F.lit(cache_root))), F.when(cached, "--prefer-cache")]
    parts += [number("--min-interval-seconds", interval, 0), number("--retry", retry, 1), number("--retry-after-seconds", wait, 2), F.lit("--live --json")]
    rows = results.where("not ok")
    return rows.select("ord", code.alias("code"), "source", "citation_key", "query_id", *acted(code), F.concat_ws(" ", *parts).alias("command"))


def title_actions(checked: DataFrame, lock: str, source_map: str) -> DataFrame:
    """One action if any source's title differs, with the first of the keys. checked: see ``titles.check``."""
    failing = checked.where("not ok").orderBy("ord").limit(SAMPLE)
    one = failing.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation_key"))), lambda x: x["citation_key"]).alias("keys")).where(F.size("keys") > 0)
    code = F.lit("REVIEW_SOURCE_TITLE_MISMATCH")
    return one.select(code.alias("code"), F.lit("").alias("citation_key"), *acted(code), command("check-source-titles", "--lock", lock, "--source-map", source_map, "--json").alias("command"), "keys")


def monitor_plan(lock: DataFrame, lock_path: str, sources: list[str] | None = None, cache_root: str = "cache", prefer_cache: bool = False, write_lock: str | None = None, fetch: bool = True, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, skipped): entries for which an official record may still come, with where to look and the command; the rest.

    lock: entries with ord. The limit comes after the filter; what it leaves out is skipped as well.
    """
    from provlake.operators.locks import sources_of
    from provlake.operators.titles import monitor_sources, needs_monitor

    rows = lock.withColumns({"source_kind": F.col("bibtex.source_kind"), "authority_source": F.col("authority.source"), "_own": monitor_sources(sources_of(), sources)})
    wanted = needs_monitor(rows.withColumn("_a", F.col("authority")).withColumn("authority", F.col("authority_source")))
    if most is not None:
        wanted = wanted.orderBy("ord").limit(most)
    looked = F.array_join(F.transform("_own", lambda s: F.concat(F.lit("--source "), s)), " ")
    told = F.concat_ws(" ", F.lit(f"{PROGRAM} reference-check --lock"), shell_quoted(F.lit(lock_path)), or_none(looked), F.concat(F.lit("--cache-root "), shell_quoted(F.lit(cache_root))), F.concat(F.lit("--citation-key "), shell_quoted(F.col("citation_key"))))
    told = F.concat_ws(" ", told, F.lit("--prefer-cache" if prefer_cache else None), F.concat(F.lit("--write-lock "), shell_quoted(F.lit(write_lock))) if write_lock else F.lit(None).cast("string"), F.lit("--fetch-official-bibtex" if fetch else None), F.lit("--live --json"))
    items = wanted.select("ord", "citation_key", "status", "authority_source", "source_kind", F.col("_own").alias("sources"), told.alias("command"))
    return items, lock.join(items.select("citation_key"), "citation_key", "left_anti").select("citation_key", "status")


def monitor_actions(items: DataFrame, writes: bool = False) -> DataFrame:
    code = F.lit("CHECK_OFFICIAL_RECORD")
    rows = items.select("ord", code.alias("code"), "citation_key", *acted(code), "command")
    return rows.withColumn("writes_files", F.lit(writes))


# --- gates and plans ----------------------------------------------------------------------------------

NO_OPTIONS = "array<struct<kind:string,directory:string>>"


def placeholders(command_: Column) -> Column:
    """Words of a command that a path must stand for first, in order, each once."""
    words = F.transform(F.regexp_extract_all(command_, F.lit(r"(?:[^\s'\"]|'[^']*'|\"[^\"]*\")+"), F.lit(0)), lambda w: F.regexp_replace(w, "['\"]", ""))
    return F.array_distinct(F.filter(words, lambda w: w.isin(K.PLACEHOLDERS)))


def inputs_ready(options: Column, there: Iterable[str]) -> Column:
    """Whether the folders of an action's inputs have files: of saved pages one, if any is asked for, of exports and fallbacks one."""
    known = F.array(*map(F.lit, there)).cast("array<string>")
    full = lambda o: F.array_contains(known, o["directory"])
    own = F.coalesce(options, F.array().cast(NO_OPTIONS))
    page = lambda o: o["kind"] == "official_html_fixture"
    text = lambda o: o["kind"].isin("official_bibtex_export_fixture", "reviewed_manual_fallback")
    fits = lambda kind: ~F.exists(own, kind) | F.exists(own, lambda o: kind(o) & full(o))
    return fits(page) & fits(text) & F.exists(own, full)


def columns_of(actions: DataFrame) -> DataFrame:
    """Actions with all columns that plans read; ``requires_network`` counts as network_required."""
    kinds = {
        "code": "string", "kind": "string", "citation_key": "string", "message": "string", "command": "string", "requires_human_review": "boolean", "writes_files": "boolean", "network_required": "boolean",
        "missing_inputs": "array<string>", "input_options": NO_OPTIONS, "preferred_input": "string", "more_commands": "map<string,string>",
    }
    if "requires_network" in actions.columns:
        own = F.col("network_required") if "network_required" in actions.columns else F.lit(None).cast("boolean")
        actions = actions.withColumn("network_required", F.coalesce(own, F.col("requires_network")))
    for c, kind in kinds.items():
        if c not in actions.columns:
            actions = actions.withColumn(c, F.lit(None).cast(kind))
    return actions


def choices(row: str = "more_commands") -> Column:
    """Commands of an action by the name of their field; empty ones are left out."""
    own = F.create_map(F.lit("command"), F.coalesce("command", F.lit("")))
    return F.map_filter(F.map_concat(F.map_filter(F.coalesce(row, F.create_map().cast("map<string,string>")), lambda k, _: k != "command"), own), lambda _, v: present(v))


def planned(actions: DataFrame, by: str = "manifest", allow_network: bool = False, allow_writes: bool = False, allow_human_review: bool = False, most: int | None = None, field: str = "command", there: Iterable[str] = ()) -> DataFrame:
    """Actions with selected, skip_reason, status, chosen (the command), available (fields), summary and hint.

    actions: by, ord, and an action's columns. The first gate that holds an action back is its reason; of those that pass
    the first ``most`` of each ``by`` are selected. there: folders that have files.
    """
    a = columns_of(actions).withColumn("_choices", choices())
    a = a.withColumns({"chosen": F.try_element_at("_choices", F.lit(field)), "available": F.array_sort(F.map_keys("_choices"))})
    a = a.withColumn("placeholders", F.coalesce(placeholders(F.col("chosen")), F.array().cast("array<string>")))
    asks = F.size(F.coalesce("missing_inputs", F.array().cast("array<string>"))) > 0
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~present(F.col("chosen")), "command_missing").when(F.size("placeholders") > 0, "input_required")
    if field != "command":
        reason = reason.when(asks & ~inputs_ready(F.col("input_options"), there), "input_required")
    reason = reason.when(on("network_required") & F.lit(not allow_network), "network_required").when(on("writes_files") & F.lit(not allow_writes), "writes_files")
    reason = reason.when(on("requires_human_review") & F.lit(not allow_human_review), "requires_human_review")
    a = a.withColumn("skip_reason", reason)
    if most is not None:
        w = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = F.sum(F.when(F.col("skip_reason").isNull(), 1).otherwise(0)).over(w)
        a = a.withColumn("_n", n).withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & (F.col("_n") > most), "max_actions").otherwise(F.col("skip_reason"))).drop("_n")
    a = a.withColumn("selected", F.col("skip_reason").isNull())
    return a.withColumns({"summary": summary(), "hint": hint()}).drop("_choices")


def summary() -> Column:
    """What an action does, in a sentence."""
    target = F.when(present(F.col("citation_key")), F.concat(F.lit(" for "), "citation_key")).otherwise("")
    says = {
        "FETCH_OFFICIAL_BIBTEX_EXPORT": ("Fetch official BibTeX export", "."), "ADD_OFFICIAL_BIBTEX_FIXTURE": ("Save reviewed official BibTeX fixture", "."), "ADD_OFFICIAL_HTML_FIXTURE": ("Save reviewed official HTML fixture", "."),
        "RETRY_OR_CACHE_LIVE_LOOKUP": ("Retry live lookup with cache preference", "."), "ADD_REFERENCE_CANDIDATES": ("Add reviewed reference candidate file", "."),
    }
    out = F.when(F.col("code") == "ADD_BIBTEX_PROVENANCE", F.when(F.col("preferred_input") == "official_bibtex_export", F.concat(F.lit("Provide official BibTeX provenance"), target, F.lit("; manual fallback remains secondary."))).otherwise(F.concat(F.lit("Provide reviewed BibTeX provenance"), target, F.lit("."))))
    for code, (head, tail) in says.items():
        out = out.when(F.col("code") == code, F.concat(F.lit(head), target, F.lit(tail)))
    return out.otherwise(F.coalesce(or_none(F.col("message")), or_none(F.col("code")), F.lit("Inspect next action.")))


def hint() -> Column:
    """What must happen before an action can run."""
    code, reason = F.col("code"), F.col("skip_reason")
    missing = F.array_join(F.when(F.size(F.coalesce("missing_inputs", F.array().cast("array<string>"))) > 0, F.col("missing_inputs")).otherwise(F.col("placeholders")), ", ")
    export = code == "FETCH_OFFICIAL_BIBTEX_EXPORT"
    return (
        F.when(export & reason.isNull(), "Ready to fetch the official BibTeX export from the selected authority.")
        .when(export & (reason == "network_required"), "Official BibTeX export is available; enable --allow-network only after live-network approval.")
        .when(code == "ADD_OFFICIAL_BIBTEX_FIXTURE", "Save the reviewed publisher BibTeX export using one of the official_bibtex_file_examples, then rerun reference-check.")
        .when(code == "ADD_OFFICIAL_HTML_FIXTURE", "Save reviewed official record HTML using one of the fixture_html_file_examples, then rerun reference-check.")
        .when(reason.isNull(), "Ready to execute with the current gates.")
        .when(reason == "network_required", "Enable --allow-network only after explicit live-network approval.")
        .when(reason == "writes_files", "Enable --allow-writes only when file updates are intended.")
        .when(reason == "requires_human_review", "Enable --allow-human-review only after reviewed inputs or source evidence are available.")
        .when((reason == "input_required") & (missing != ""), F.concat(F.lit("Provide reviewed input paths before execution: "), missing, F.lit(".")))
        .when(reason == "input_required", "Provide reviewed input paths before execution.")
        .when(reason == "command_missing", "No executable command is attached to this action; handle it manually.")
        .when(reason == "max_actions", "Not selected because the max-actions limit was reached.")
        .otherwise("Inspect this action before execution.")
    )


def plan_counts(plan: DataFrame, by: str = "manifest") -> DataFrame:
    """by, actions, selected, skipped, failed, ok. plan may have executed and returncode."""
    bad = failed(plan)
    return plan.groupBy(by).agg(F.count(F.lit(1)).alias("actions"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("skipped"), F.count_if(bad).alias("failed")).withColumn("ok", F.col("failed") == 0)


def failed(plan: DataFrame) -> Column:
    if "executed" not in plan.columns:
        return F.lit(False)
    return F.coalesce(F.col("executed"), F.lit(False)) & (F.coalesce("returncode", F.lit(0)) != 0)


def status(plan: DataFrame) -> Column:
    """succeeded or failed of what has run, planned_not_executed, or skipped and why."""
    ran = F.coalesce(F.col("executed"), F.lit(False)) if "executed" in plan.columns else F.lit(False)
    return F.when(ran, F.when(failed(plan), "failed").otherwise("succeeded")).when(F.col("selected"), "planned_not_executed").otherwise(F.concat(F.lit("skipped_"), F.coalesce("skip_reason", F.lit("unknown"))))


def next_step(plan: DataFrame, by: str = "manifest") -> DataFrame:
    """by, state (ready, blocked, none), code, command, summary, hint, skip_reason: the first selected action, or else the first with a command."""
    a = plan.withColumns({"_has": present(F.col("chosen")), "_x": F.struct("ord", "code", "chosen", "summary", "hint", "skip_reason")})
    first = a.groupBy(by).agg(F.min(F.when(F.col("selected") & F.col("_has"), F.col("_x"))).alias("_s"), F.min(F.when(F.col("_has"), F.col("_x"))).alias("_a"))
    x = F.coalesce("_s", "_a")
    return first.select(by, F.when(F.col("_s").isNotNull(), "ready").when(F.col("_a").isNotNull(), "blocked").otherwise("none").alias("state"), x["code"].alias("code"), x["chosen"].alias("command"), x["summary"].alias("summary"), F.coalesce(x["hint"], F.lit("No next-action command is available.")).alias("hint"), x["skip_reason"].alias("skip_reason"))


def manifest_summary(plan: DataFrame) -> DataFrame:
    """status, n of actions over all manifests; what has failed or is left is where status isn't succeeded."""
    return plan.select(status(plan).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def remaining(plan: DataFrame) -> DataFrame:
    return plan.withColumn("status", status(plan)).where("status <> 'succeeded'")


# --- what publishers need ----------------------------------------------------------------------------

# Record pages, export and PDF addresses of publishers, and what to know of them.
GUIDANCE = {
    "acm": ("https://dl.acm.org/doi/DOI https://dl.acm.org/doi/abs/DOI", "https://dl.acm.org/action/exportCiteProcCitation?dois=URL_ENCODED_DOI&targetFile=custom-bibtex&format=bibTex", "https://dl.acm.org/doi/pdf/DOI", "ACM may block automated HTML fetches; use reviewed official HTML or official BibTeX fixtures when needed."),
    "springer": ("https://link.springer.com/chapter/DOI https://link.springer.com/article/DOI", None, "https://link.springer.com/content/pdf/DOI.pdf", "Springer BibTeX links may contain escaped query separators; keep the reviewed official export URL unescaped."),
    "ieee": ("https://ieeexplore.ieee.org/document/DOCUMENT_ID", None, None, "IEEE pages often store metadata in scripts; save reviewed official HTML if live parsing is blocked."),
    "pnas": ("https://www.pnas.org/doi/abs/DOI https://www.pnas.org/doi/full/DOI", None, "https://www.pnas.org/doi/pdf/DOI", None),
    "science": ("https://www.science.org/doi/abs/DOI https://www.science.org/doi/full/DOI", None, "https://www.science.org/doi/pdf/DOI", None),
    "frontiers": ("https://www.frontiersin.org/journals/JOURNAL/articles/DOI/full", None, "Replace the final /full path segment with /pdf.", None),
    "mdpi": ("https://www.mdpi.com/JOURNAL/VOLUME/ISSUE/ARTICLE", None, "Append /pdf or replace /htm with /pdf.", None),
    **dict.fromkeys(["oxford", "cambridge", "lipics"], ("", None, None, "Use reviewed official HTML and official BibTeX fixtures when the record page does not expose a verified BibTeX endpoint.")),
}


def guidance(source: Column, key: Column) -> Column:
    """struct of a source's files for a key, and what is to be known of the publisher."""
    text = lambda v: F.lit(v).cast("string")
    table = F.create_map(*(x for s, (pages, export, pdf, note) in GUIDANCE.items() for x in (F.lit(s), F.struct(F.split(text(pages), " ").alias("record_url_patterns"), text(export).alias("official_bibtex_url_pattern"), text(pdf).alias("source_pdf_url_pattern"), text(note).alias("live_fetch_note")))))
    more = F.try_element_at(table, source)
    files = lambda *names: F.when(present(key), F.array(*names)).otherwise(F.array().cast("array<string>"))
    dot = lambda *parts: F.concat(key, *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.struct(
        source.alias("source"), files(dot(".", source, ".html"), dot(".html")).alias("fixture_html_file_examples"), files(dot(".", source, ".bib"), dot(".source.bib"), dot(".bib")).alias("official_bibtex_file_examples"),
        *(more[f].alias(f) for f in ("record_url_patterns", "official_bibtex_url_pattern", "source_pdf_url_pattern", "live_fetch_note")),
    )
