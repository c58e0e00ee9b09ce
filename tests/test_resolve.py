from pyspark.sql import functions as F

from provlake.operators import resolve

PAIR = (
    "query_id string, ord int, q_title string, q_authors array<string>, q_year int, q_doi string, q_arxiv_id string, c_source string, c_title string, c_authors array<string>, c_year int, "
    "c_doi string, c_arxiv_id string, c_url string, c_official boolean, c_bibtex_url string, c_priority int, c_pending boolean"
)


def pair(query="q", ord=0, q_title="A Paper", q_authors=("Ann Lee",), q_year=2024, q_doi=None, q_arxiv=None, source="x", title="A Paper", authors=("Ann Lee",), year=2024, doi=None, arxiv=None, url="u", official=True, bib="b", priority=1, pending=False):
    return (query, ord, q_title, list(q_authors), q_year, q_doi, q_arxiv, source, title, list(authors), year, doi, arxiv, url, official, bib, priority, pending)


def decide(spark, *pairs, queries=None):
    df = spark.createDataFrame(list(pairs), PAIR)
    q = spark.createDataFrame([(x,) for x in (queries or sorted({p[0] for p in pairs}))], "query_id string")
    return {r["query_id"]: r for r in resolve.decide(q, resolve.best(resolve.score(df))).collect()}


def test_official_export_wins_over_index_record(spark):
    d = decide(spark, pair(), pair(ord=1, source="index", official=False, bib=None, priority=4))["q"]
    assert (d["decision"], d["status"], d["score"], d["candidate_ord"]) == ("selected", "verified_official_bibtex", 100, 0)


def test_two_dois_conflict(spark):
    d = decide(spark, pair(doi="10.1/a", url="u1"), pair(ord=1, doi="10.1/b", url="u2"))["q"]
    assert (d["status"], d["issue"], d["n_dois"], d["n_official"]) == ("ambiguous", "DOI_CONFLICT", 2, 2)


def test_copy_of_best_is_no_tie(spark):
    d = decide(spark, pair(), pair(ord=1))["q"]
    assert d["decision"] == "selected"


def test_doi_hit_without_or_with_other_title_blocks(spark):
    d = decide(spark, pair("m", q_doi="10.1/A", doi="10.1/a", title=""), pair("t", q_doi="10.1/a", doi="10.1/a", title="A Pap"))
    assert [(d[k]["score"], d[k]["issue"]) for k in "mt"] == [(100, "AUTHORITY_TITLE_MISSING"), (100, "AUTHORITY_TITLE_MISMATCH")]


def test_author_order_arxiv_pending_and_nothing(spark):
    d = decide(
        spark,
        pair("a", q_authors=["Liang, Percy"], authors=["Percy Liang"], bib=None),
        pair("x", q_arxiv="2410.1", arxiv="2410.1", bib=None, official=False),
        pair("p", pending=True),
        pair("l", title="Other", official=False, bib=None),
        queries=["a", "x", "p", "l", "none"],
    )
    assert d["a"]["score"] == 95 and d["x"]["score"] == 98 and d["x"]["status"] == "arxiv_fallback_verified"
    assert d["p"]["status"] == "official_record_pending" and d["l"]["issue"] == "LOW_CONFIDENCE" and d["none"]["issue"] == "NO_CANDIDATES"


def test_ties_keep_input_order(spark):
    d = decide(spark, pair(ord=5, url="same"), pair(ord=2, source="y", url="same"))["q"]
    assert d["candidate_ord"] == 2


def test_trace(spark):
    r = resolve.score(spark.createDataFrame([pair()], PAIR)).select(F.size("trace").alias("n")).first()
    assert r["n"] == 5
