from pyspark.sql import functions as F

from provlake.functions import text as T
from provlake.operators import locks, reports
from provlake.sources import loaders, parsers, records

BIB = """@string{nips = {Neural Info}}
@comment{ignored, x = {1}}
@inproceedings{k1, title = {A {Nested {Deep}} Title}, booktitle = nips # " 2024", note = "a, b", pages = {1 -- 5}, doi = {https://doi.org/10.1/AB}, publisher = {association for computing machinery}}
@article{k2, year = 2020, title = "Quoted {"}x"}
@misc{open, title = {never closed
"""


def test_bibtex(spark):
    got = parsers.bibtex_entries(BIB)
    assert [e["citation_key"] for e in got] == ["k1", "k2", "open"]
    f = dict(got[0]["fields"])
    assert f["title"] == "A {Nested {Deep}} Title" and f["booktitle"] == "Neural Info 2024" and f["note"] == "a, b"
    assert dict(got[1]["fields"])["year"] == "2020" and got[2]["error"] and not got[0]["error"]
    rows = parsers.bib_entries(spark.createDataFrame([("f", BIB), ("g", None)], "path string, text string"))
    n = rows.where("citation_key = 'k1'").select(parsers.normal_fields(F.col("fields")).alias("n"), parsers.rekeyed(F.col("raw_text"), F.lit("new")).alias("raw")).first()
    assert n["n"]["doi"] == "10.1/ab" and n["n"]["pages"] == "1--5" and n["n"]["publisher"] == "ACM" and n["raw"].startswith("@inproceedings{new,")


def test_tex(spark):
    tex = "Intro.\n\nWe cite \\cite[see][2]{a, b}. Next one\ncites \\citep{c}! % \\cite{d}\n\\input{sec/one} % \\input{no}\n"
    files = spark.createDataFrame([("m.tex", tex)], "path string, text string")
    assert {r["citation_key"] for r in parsers.cited_keys(files).collect()} == {"a", "b", "c", "d"}
    assert [r["target"] for r in parsers.included(files).collect()] == ["sec/one.tex"]
    assert [(r["line"], r["citation_key"]) for r in parsers.claim_stubs(files).collect()] == [(3, "a"), (3, "b"), (4, "c")]


def claims_of(text):
    return [(claim, key) for _, _, claim, key in parsers.stubs_of(text)]


def test_claim_texts():
    two = "Tool-use benchmarks expose prompt-injection attacks \\cite{alpha2024}, while policy benchmarks cover permission misuse \\cite{beta2025}."
    assert claims_of(two) == [("Tool-use benchmarks expose prompt-injection attacks", "alpha2024"), ("policy benchmarks cover permission misuse", "beta2025")]
    wrapped = "Modern tool-using agents extend language models into interactive environments,\nwhich makes prompt injection and source integrity failures more consequential\n\\cite{k}.\n"
    assert list(parsers.stubs_of(wrapped))[0][0] == 3
    assert claims_of(wrapped) == [("which makes prompt injection and source integrity failures more consequential", "k")]
    serial = "The principles emphasize findability, accessibility, interoperability, and reuse of digital assets \\cite{w}."
    assert claims_of(serial) == [("The principles emphasize findability, accessibility, interoperability, and reuse of digital assets", "w")]
    heads = "\\section{Background}\nReAct interleaves reasoning traces with task actions \\cite{y}.\n\\paragraph{Least Privilege, Delegation} AuthBench evaluates file-level permission policies \\cite{z}.\n"
    assert claims_of(heads) == [("ReAct interleaves reasoning traces with task actions", "y"), ("AuthBench evaluates file-level permission policies", "z")]
    assert claims_of("It ends. \\cite{k}") == [("", "k")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "source string, target string")
    got = {(r["path"], r["depth"]) for r in parsers.closure(edges, spark.createDataFrame([("a",)], "path string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1)}


def test_closure_of_many_ways(spark):
    """Layers of two nodes, each joined to both of the next: two to the power of the layers ways, but few paths."""
    layers = 14
    edges = [(f"{i}{a}", f"{i + 1}{b}") for i in range(layers) for a in "xy" for b in "xy"]
    got = parsers.closure(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("0x",)], "path string"))
    assert got.count() == 2 * layers + 1 and got.agg(F.max("depth")).first()[0] == layers


def test_include_depth(spark):
    files = [("p", f"d/f{i}.tex", f"\\input{{f{i + 1}}}") for i in range(5)] + [("p", "d/f5.tex", "end")]
    sources, issues = parsers.tex_documents(spark.createDataFrame(files, "project string, path string, text string"), spark.createDataFrame([("p", "d/f0.tex")], "project string, path string"), depth=3)
    assert [r["path"] for r in sources.orderBy("ord").collect()] == [f"d/f{i}.tex" for i in range(4)]
    r = issues.first()
    assert (r["code"], r["evidence"], r["severity"]) == ("TEX_INCLUDE_DEPTH_EXCEEDED", ["f4.tex", "3"], "warning")


def test_html_and_blocks(spark):
    page = "<meta content='A  Title' name=\"citation_title\"><meta name='citation_doi' content='doi:10.1234/x'><a href='/x.bib'>BibTeX</a><a href='/y'>Pdf</a>"
    c = records.candidates(spark.createDataFrame([("nature", "https://h/p", page)], "source string, url string, html string")).first()
    assert (c["c_title"], c["c_doi"], c["c_bibtex_url"], c["c_venue"]) == ("A Title", "10.1234/x", "https://h/x.bib", "Nature Portfolio")
    t = spark.createDataFrame([("p", "[page 1]\none\n[page 3]\ntwo"), ("q", "a\n\nb"), ("l", "x\ny"), ("m", "[page 2]\nu\nv")], "path string, text string")
    got = [(r["path"], r["label"], r["text"]) for r in parsers.blocks(t).orderBy("path", "block_ord").collect()]
    # lines make blocks within a page only; elsewhere a text without blank lines is one paragraph
    assert got == [("l", "paragraph 1", "x y"), ("m", "page 2 paragraph 1", "u"), ("m", "page 2 paragraph 2", "v"), ("p", "page 1", "one"), ("p", "page 3", "two"), ("q", "paragraph 1", "a"), ("q", "paragraph 2", "b")]


def test_text_functions(spark):
    r = spark.range(1).select(
        T.normalize_title(F.lit("\ufb01ne {A} \\\\& B \u2014 \u201cC\u201d.  ")).alias("title"), T.normalize_author(F.lit("Þ. Đorđević-Müller")).alias("author"),
        T.cache_key(F.lit("https://a/b?c/")).alias("cache"), T.arxiv_id(F.lit("arXiv:2401.00001v2")).alias("arxiv"), F.bround(F.lit(1) / 32, 4).alias("half"),
        T.is_weak_kind(F.lit(" OpenAlex-Abstract ")).alias("weak"), T.host_matches(F.lit("https://Sub.Example.com/x"), F.lit("example.com")).alias("host"), T.host_matches(F.lit("no url"), F.lit("example.com")).alias("nohost"),
        T.shell_quoted(F.lit("it's")).alias("shell"), locks.month(F.lit("{September}")).alias("month"), locks.month(F.lit("13")).alias("no_month"),
    ).first()
    assert r["title"].startswith("fine a & b - ") and "muller" in r["author"] and r["cache"].startswith("https_a_b_c_") and "__" not in r["cache"] and r["arxiv"] == "2401.00001"
    assert float(r["half"]) == 0.0312 and r["weak"] and r["host"] and not r["nohost"]
    assert r["shell"] == "'it'\"'\"'s'" and r["month"] == 9 and r["no_month"] is None


def test_loaders(spark, tmp_path):
    (tmp_path / "claims.tsv").write_text("claim_id\tcitation_key\tstatus\nc1\tk\t\n")
    at = f"file://{tmp_path}/claims.tsv"
    row = loaders.claims(spark, at).first()
    assert row["claim_id"] == "c1" and row["status"] == "" and row["notes"] == "" and loaders.missing_columns(spark, at) == ["source_location"]
    (tmp_path / "lock.json").write_text('{"project": "p", "more": 1, "entries": [{"citation_key": "k", "status": "s", "record": {"title": "t", "authors": ["a"]}, "other": 2}]}')
    e = loaders.lock_entries(spark, f"file://{tmp_path}/lock.json").first()
    assert (e["citation_key"], e["record"]["title"], e["project"]) == ("k", "t", "p")
    for missing in (loaders.claims, loaders.lock_entries):
        assert missing(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "map.json").write_text('{"sources": [{"citation_key": "k", "path": "a/s.txt", "source_kind": "Abstract"}, {"citation_key": "", "path": "x"}]}')
    m = loaders.source_map(spark, f"file://{tmp_path}/map.json").collect()
    assert [(r["source_text"], r["source_label"], r["evidence_kind"]) for r in m] == [(f"file://{tmp_path}/a/s.txt", "s.txt", "abstract")]
    (tmp_path / "r.jsonl").write_text('{"claim_id": "c", "decision": "checked"}\n\n{"claim_id": "d", "decision": "x"}\n')
    assert [r["claim_id"] for r in loaders.reviews(spark, f"file://{tmp_path}/r.jsonl").orderBy("ord").collect()] == ["c", "d"]
    (tmp_path / "bad.jsonl").write_text('{"citation_key": "c"}\nno\n')
    try:
        loaders.title_reviews(spark, f"file://{tmp_path}/bad.jsonl").collect()
        raise AssertionError("a line that is no object must fail")
    except Exception as e:
        assert ":2: no JSON object" in str(e)
    q = loaders.one_query(spark, "T", authors=["A, B", "C"], citation_key="k").first()
    assert q["query_id"] == "k" and q["authors"] == ["A", "B", "C"]
    assert loaders.masked("secretvalue") == "se...ue" and loaders.masked("") == ""
    status = loaders.auth_status(["x", "y"], {"x": "secretvalue"})
    assert status[0]["masked"] == "se...ue" and status[0]["origin"] == "config" and status[1]["issue"] == "AUTH_VALUE_MISSING"
    assert reports.shown_path("/a/b/c", "/a") == "b/c" and reports.shown_path("/z", "/a") == "/z" and reports.beside_claims("/a/my_claims.tsv", "review.md") == "/a/my_review.md"
    if not loaders.pdf_readable():
        assert loaders.pdf_issue(["a.pdf"] * 7)["evidence"] == ["a.pdf"] * 5
        (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
        assert loaders.source_texts(spark, [f"file://{tmp_path}/x.pdf"]).first()["text"] is None
