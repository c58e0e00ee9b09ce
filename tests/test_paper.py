"""Whole flows on small manuscripts: audit, reference check, fetch stage, reports."""

import json

import pytest
from pyspark.sql import functions as F

from provlake.operators import actions, claim_sources, locks, paper, reports, resolve, source_files, titles, upsert
from provlake.sources import fetch, loaders, parsers, records

KEY = "lee2024"
ENTRY = "@inproceedings{lee2024, title = {A Long {Study}}, author = {Lee, Ann and C}, year = 2024, doi = {10.1/x}}"
CLAIM = dict.fromkeys(loaders.CLAIM_COLUMNS, "")


def lock_of(spark, *entries):
    rows = [json.dumps(e) for e in entries]
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", loaders.LOCK_ENTRY + ", project string, ord int").alias("e")).select("e.*")


def entry(project="p", key=KEY, **more):
    e = {"project": project, "ord": 0, "citation_key": key, "short_title": "A", "status": "verified_official_bibtex", "record": {"title": "A Long Study", "authors": ["Ann Lee"], "year": "2024", "doi": "10.1/x", "url": "https://aclanthology.org/x"}}
    e |= {"authority": {"source": "acl", "record_url": "https://aclanthology.org/x", "record_type": "conference_proceedings", "source_priority": 1, "bibtex_url": "u"}, "bibtex": {"source_kind": "official_export", "normalized_sha256": "placeholder"}}
    return e | more


def claims_of(spark, *rows):
    names = ["project", "ord", *loaders.CLAIM_COLUMNS]
    return spark.createDataFrame([tuple((CLAIM | r).get(n) for n in names) for r in rows], ", ".join(f"{n} {'int' if n == 'ord' else 'string'}" for n in names))


@pytest.fixture(scope="module")
def audited(spark):
    """Two projects with one key: one in order but for its claim, one whose title, include and source text are wrong."""
    bibs = spark.createDataFrame([("p", ENTRY), ("q", ENTRY.replace("A Long {Study}", "Other") + "\n@misc{idle, title={x}}")], "project string, text string")
    lock = lock_of(spark, entry(), entry("q"))
    tex = spark.createDataFrame([("p", "m.tex", "Claims stand here with words \\cite{lee2024}."), ("q", "m.tex", "\\input{gone} text \\cite{lee2024}")], "project string, path string, text string")
    claims = claims_of(
        spark, {"project": "p", "ord": 0, "claim_id": "claim-0001", "claim_text": "attention improves translation quality", "citation_key": KEY, "status": "claim_unchecked"},
        {"project": "q", "ord": 1, "claim_id": "claim-0001", "claim_text": "nothing matches whatsoever", "citation_key": KEY + ", none", "status": "checked", "source_location": "p", "quote_or_evidence": ""},
    )
    sm = spark.createDataFrame([("p", 0, KEY, "/s/p.txt", "p.txt", "p.txt", "source_text"), ("q", 1, KEY, "/s/q.txt", "q.txt", "q.txt", "source_text")], "project string, ord int, citation_key string, source_text string, source_text_raw string, source_label string, evidence_kind string")
    texts = spark.createDataFrame([("/s/p.txt", "A Long Study\n\nWe show that attention improves the quality of machine translation."), ("/s/q.txt", "Unrelated heading\n\nblah")], "path string, text string")
    roots = tex.select("project", "path").where("path = 'm.tex'")
    return paper.paper_audit(bibs, lock, tex, roots, claims, sm, texts, submission=True), lock


def test_audit_of_projects(audited):
    out, _ = audited
    found = {(r["project"], r["code"], r["citation_key"]) for r in out["issues"].collect()}
    assert ("q", "TITLE_MISMATCH", KEY) in found and ("p", "TITLE_MISMATCH", KEY) not in found
    assert ("q", "TEX_INCLUDE_MISSING", None) in found and ("q", "BIB_ENTRY_NOT_CITED", "idle") in found
    assert ("q", "CLAIM_EVIDENCE_NOT_FOUND_IN_SOURCE", f"{KEY},none") in found
    assert ("q", "SOURCE_TITLE_MISMATCH", KEY) in found and not any(p == "p" and c.startswith("SOURCE_TITLE") for p, c, _ in found)
    # the claim of p has found a quote, which is not final yet; that stands for its being unchecked
    assert ("p", "CLAIM_STATUS_NOT_FINAL", KEY) in found and ("p", "CLAIM_NOT_CHECKED", KEY) not in found
    rows = {r["project"]: r for r in out["claims"].collect()}
    assert rows["p"]["status"] == "needs_review" and rows["p"]["source_location"] == "p.txt: paragraph 2" and rows["p"]["notes"].startswith("Source-map overlap score 4, coverage 1.00;")
    assert {r["project"]: r["ok"] for r in paper.gate(out["issues"]).collect()} == {"p": False, "q": False}


def test_issues_of_one_key_differ_by_their_evidence(spark):
    bibs = spark.createDataFrame([("p", ENTRY.replace("doi = {10.1/x}", "doi = {}"))], "project string, text string")
    lock = lock_of(spark, entry(status="draft", bibtex={"source_kind": "unknown", "normalized_sha256": ""}))
    tex = spark.createDataFrame([("p", "m.tex", "\\cite{lee2024}")], "project string, path string, text string")
    said = {"project": "p", "citation_key": KEY, "status": "checked", "source_location": "p", "evidence_kind": "source text"}
    claims = claims_of(
        spark, said | {"ord": 0, "claim_id": "claim-1", "claim_text": "models always win prizes", "quote_or_evidence": "models exist"},
        said | {"ord": 1, "claim_id": "claim-2", "claim_text": "networks never lose weight", "quote_or_evidence": "weight matters"},
        said | {"ord": 2, "claim_id": "", "claim_text": "", "quote_or_evidence": "x", "status": "too-strong"},
        said | {"ord": 3, "claim_id": "claim-4", "claim_text": "weighty words stand here", "quote_or_evidence": "words stand here", "evidence_kind": " Abstract "},
    )
    none = spark.createDataFrame([], "project string, ord int, citation_key string, source_text string, source_text_raw string, source_label string, evidence_kind string")
    out = paper.paper_audit(bibs, lock, tex, tex.select("project", "path"), claims, none, spark.createDataFrame([], "path string, text string"))
    got = [(r["code"], r["message"], list(r["evidence"])) for r in out["issues"].collect()]
    assert not any("{}" in m for _, m, _ in got)
    low = "has low lexical overlap with its evidence."
    for expected in [
        ("NON_PASSING_STATUS", "Lockfile status is draft.", []),
        ("UNVERIFIED_BIBTEX_SOURCE", "BibTeX source kind is unknown.", []),
        ("OFFICIAL_EXPORT_NOT_USED", "Official BibTeX endpoint exists, but entry is not marked as official export.", ["u"]),
        ("DOI_MISSING", "BibTeX entry is missing DOI present in the lockfile record.", ["10.1/x"]),
        ("CLAIM_EVIDENCE_LOW_OVERLAP", f"Claim claim-1 {low}", ["models"]),
        ("CLAIM_EVIDENCE_LOW_OVERLAP", f"Claim claim-2 {low}", ["weight"]),
        ("CLAIM_EVIDENCE_LOW_OVERLAP", f"Claim (missing id) {low}", []),
        ("CLAIM_MAY_BE_TOO_STRONG", "Claim claim-1 uses strong wording that needs careful source support.", ["always"]),
        ("CLAIM_MAY_BE_TOO_STRONG", "Claim claim-2 uses strong wording that needs careful source support.", ["never"]),
        ("CLAIM_NOT_CHECKED", "Claim (missing id) is marked too-strong.", []),
        ("CLAIM_WEAK_EVIDENCE_NOT_CHECKABLE", "Claim claim-4 is marked checked using weak evidence kind Abstract.", ["Abstract"]),
    ]:
        assert expected in got
    assert sum(c in ("CLAIM_EVIDENCE_LOW_OVERLAP", "CLAIM_MAY_BE_TOO_STRONG") for c, _, _ in got) == 5


def test_follow_up_and_reports(audited):
    out, lock = audited
    acts = {(r["project"], r["code"]) for r in paper.follow_up(out, {"tex": "m.tex", "bib": "b", "lock": "l", "claims": "c"}).collect()}
    assert ("p", "EXPORT_REVIEW_BUNDLE") in acts and ("q", "REVIEW_NO_MATCH_CLAIMS") in acts and ("p", "EXPORT_HANDOFF") not in acts
    one = out["issues"].where("project = 'q'")
    text = reports.audit(lock.where("project = 'q'"), one, out["notes"].where("project = 'q'"))
    assert "- manuscript: blocked (2 blocking, 0 warnings)" in text and f"- `TITLE_MISMATCH` `{KEY}`: BibTeX title" in text and "- [ ] Blocking issue count is zero." in text
    assert "### claim-0001 — `lee2024`" in reports.claims(out["claims"].where("project = 'p'"))
    assert json.loads(reports.lockfile(lock.where("project = 'p'"), "p"))["entries"][0]["citation_key"] == KEY
    assert json.loads(reports.envelope("x", blocking=[1]))["ok"] is False
    assert paper.released(out, lock).count() == 0


def test_body_passage_over_title(spark):
    """A passage of the body is taken over a title that shares as many words."""
    body = "Prompt injection attacks against tool agents succeed often. " + "This longer passage explains with many further words how such attacks against agents were measured in detail over several environments and tasks, so that readers can judge them on their own terms. " * 2
    texts = spark.createDataFrame([("s", f"Prompt Injection Attacks Against Tool Agents\n\n{body}")], "path string, text string")
    sm = spark.createDataFrame([(KEY, "s", "s", "s", "source_text", 0)], "citation_key string, source_text string, source_text_raw string, source_label string, evidence_kind string, ord int")
    claims = claims_of(spark, {"project": "p", "ord": 0, "claim_id": "claim-1", "claim_text": "prompt injection attacks against tool agents", "citation_key": KEY})
    for mode in ("lexical", "semantic-lite"):
        assert claim_sources.best_sources(claims, sm, texts, mode).first()["label"] == "paragraph 2"
    top = claim_sources.review_candidates(claims, sm, texts).orderBy("rank").collect()
    assert [r["confidence"] for r in top] == ["high", "low"] and top[0]["source_location"] == "s: paragraph 2"
    text = reports.review_bundle(claim_sources.review_bundle(claims, spark.createDataFrame([(KEY,)], "citation_key string").select("citation_key", F.struct("citation_key").alias("reference")), claim_sources.review_candidates(claims, sm, texts)))
    assert "confidence=high" in text and "### claim-1" in text


def test_reference_check_and_provenance(spark):
    lock = lock_of(spark, entry(status="draft"), entry(key="bare", status="draft", record={"title": "Bare"}), entry(key="pre", status="draft", record={"title": "Pre", "arxiv_id": "2401.00001"}))
    feed = '<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>Pre</title><author><name>Bo Li</name></author><published>2024-01-01</published></entry></feed>'
    asked = locks.query_of(lock)
    arxiv = records.arxiv_candidates(asked.where("query_id = 'pre'").select("query_id", "preferred_venues").withColumn("body", F.lit(feed)), "2024-05-01")
    page = '<meta name="citation_title" content="A Long Study"><meta name="citation_author" content="Ann Lee"><meta name="citation_publication_date" content="2024">'
    saved = records.candidates(spark.createDataFrame([(KEY, 0, "acl", "https://aclanthology.org/x/", page)], "query_id string, ord int, source string, url string, html string"))
    both = resolve.stacked(saved, arxiv)
    d, issues = source_files.reference_check(lock, both)
    got = {r["citation_key"]: r for r in d.collect()}
    assert got[KEY]["status"] == "verified_official_bibtex" and got[KEY]["authority"]["bibtex_url"] == "https://aclanthology.org/x.bib"
    assert got["pre"]["status"] == "arxiv_fallback_verified" and got["pre"]["authority"]["record_type"] == "preprint_record"
    assert {(r["code"], r["citation_key"]) for r in issues.collect()} == {("NO_CANDIDATES", "bare"), ("REFERENCE_CANDIDATES_MISSING", "bare")}
    live = spark.createDataFrame([("bare", "acl", False, "URLError: x"), (KEY, "acl", False, "URLError: x")], "citation_key string, source string, ok boolean, error string")
    _, told = source_files.reference_check(lock, both, live)
    assert {(r["code"], r["citation_key"]) for r in told.collect()} == {("NO_CANDIDATES", "bare"), ("REFERENCE_LIVE_LOOKUP_FAILED", "bare")}
    codes = {r["code"] for r in actions.reference_actions(told.withColumn("ord", F.lit(0)), d, "l").collect()}
    assert codes == {"ADD_REFERENCE_CANDIDATES", "RETRY_OR_CACHE_LIVE_LOOKUP", "ADD_OFFICIAL_HTML_FIXTURE"}

    selected = d.where("decision = 'selected'").join(both.withColumnRenamed("query_id", "citation_key").withColumnRenamed("ord", "candidate_ord"), ["citation_key", "candidate_ord"])
    files = source_files.named(spark.createDataFrame([("o/lee2024.acl.bib", "A Long Study", "10.1/X", ENTRY)], "path string, title string, doi string, text string"))
    none = files.limit(0)
    done, issues = source_files.provenance(selected, files, none, as_of="2024-06-01")
    rows = {r["citation_key"]: r for r in done.collect()}
    assert rows[KEY]["bibtex"]["source_kind"] == "official_export" and rows[KEY]["title_check"] == "exact_normalized_match" and rows["pre"]["bibtex"]["source_kind"] == "arxiv_manual_normalized" and issues.count() == 0
    built = locks.built_entries(done, "2024-06-01")
    merged = {r["citation_key"]: r for r in locks.merged(lock.drop("project", "ord"), built).collect()}
    assert len(merged) == 3 and merged[KEY]["status"] == "verified_official_bibtex" and merged["pre"]["bibtex"]["fallback_reason"] == locks.ARXIV_REASON
    _, issues = source_files.provenance(selected, files.withColumn("title", F.lit("Wrong")), none)
    assert {r["code"] for r in issues.collect()} == {"OFFICIAL_BIBTEX_TITLE_MISMATCH", "BIBTEX_PROVENANCE_INPUT_MISSING"}


def test_synced_bibliography(spark):
    bib = spark.createDataFrame([("p", f"% mine\n{ENTRY}\n\n@misc{{keep, title={{y}}}}\n")], "path string, text string")
    spans = parsers.bib_spans(bib)
    canonical = ENTRY.replace("2024, doi", "2025, doi")
    lock = spark.createDataFrame([(KEY, "verified_official_bibtex", "official_export", canonical, "placeholder"), ("new", "verified_official_bibtex", "official_export", "@misc{new, title={z}}", "")], "citation_key string, status string, source_kind string, canonical string, stored_sha string")
    acts = upsert.sync_action(spans.where("citation_key is not null").select("citation_key", "text"), lock).withColumn("path", F.lit("p"))
    r = upsert.synced_text(spans, acts).first()
    assert r["text"] == f"% mine\n\n{canonical}\n\n@misc{{keep, title={{y}}}}\n\n@misc{{new, title={{z}}}}\n" and r["ok"] and r["changes"] == 2
    wanted = spark.createDataFrame([("new",), ("nowhere",)], "citation_key string")
    some = {r["citation_key"]: r["reason"] for r in upsert.sync_action(spans.where("citation_key is not null").select("citation_key", "text"), lock, wanted, add_missing=False).collect()}
    assert some == {KEY: "not_requested", "keep": "not_requested", "new": "missing_from_bib_add_missing_disabled", "nowhere": "lock_entry_missing"}


def test_reviews_apply_all_or_none(spark):
    claims = claims_of(spark, {"project": "p", "ord": 0, "claim_id": "c1", "status": "draft", "notes": "old"})
    good = spark.createDataFrame([(0, "c1", "checked", "p. 2"), (1, "c1", "too_strong", None)], "ord int, claim_id string, decision string, source_location string")
    r = upsert.apply_reviews(claims, good, allow_checked=True).first()
    assert (r["status"], r["source_location"], r["evidence_kind"]) == ("too_strong", "p. 2", "source_text") and r["notes"] == "old Review decision: checked. Review decision: too_strong."
    bad = good.unionByName(spark.createDataFrame([(2, "zz", "checked", None)], good.schema))
    assert upsert.apply_reviews(claims, bad).first()["status"] == "draft"


def test_fetch_stage(spark):
    requests = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("b", "limited"), ("b", "broken")], "source string, url string")
    cache = spark.createDataFrame([("a", "u1", 200, "kept", "sha", "2024-01-01")], "source string, url string, status int, body string, body_sha256 string, fetched_at string")
    seen = []

    def fetcher(url):
        if url == "limited":
            seen.append(url)
            if len(seen) < 2:
                raise fetch.RateLimited("HTTPError: HTTP Error 429: slow", 0.01)
            return b"late"
        if url == "broken":
            raise OSError("no")
        return url.encode()

    got = {r["url"]: r for r in fetch.fetch(requests, fetcher, cache, retry=1, as_of="2024-02-02").collect()}
    assert got["u1"]["body"] == "kept" and got["u2"]["body"] == "u2" and got["limited"]["body"] == "late" and got["broken"]["error"] == "OSError: no"
    items = spark.createDataFrame([("k", "u", "d/k.pdf"), ("m", None, "d/m.pdf"), ("t", "u", "d/t.pdf"), ("x", "broken", "d/x.pdf")], "citation_key string, url string, output string")
    done = fetch.download(items, fetcher, spark.createDataFrame([("d/t.pdf",)], "path string"))
    assert {r["citation_key"]: r["status"] for r in done.collect()} == {"k": "downloaded", "m": "missing_url", "t": "skipped_exists", "x": "download_failed"}
    assert fetch.download_issues(done).first()["citation_key"] == "x"


def test_title_report_and_action(spark):
    sm = spark.createDataFrame([(KEY, "s", "s", "s", 0)], "citation_key string, source_text string, source_text_raw string, source_label string, ord int")
    checked = titles.check(sm, spark.createDataFrame([(KEY, "A Long Study")], "citation_key string, title string"), spark.createDataFrame([("s", "Wholly Other Words\n")], "path string, text string"))
    assert "- `lee2024`: expected `A Long Study`; source candidate `Wholly Other Words`" in reports.source_titles(checked, "m")
    r = actions.title_actions(checked, "l", "m").first()
    assert r["code"] == "REVIEW_SOURCE_TITLE_MISMATCH" and r["keys"] == [KEY]
    plan = actions.planned(spark.createDataFrame([("m", 0, "A", "run LOCK"), ("m", 1, "B", "go")], "manifest string, ord int, code string, command string"))
    assert "## Recommended Next\n- Code: `B`" in reports.action_summary(plan)
