"""Scored entity resolution: each query's best candidate, near ties, conflicts and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.functions import constants as K
from provlake.functions.text import first_present, normalize_author, normalize_title, or_none, present, same_author


def score(pairs: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds score, title_equal and trace to rows that have q_* of a query and c_* of a candidate.

    q_title, q_authors, q_year, q_doi, q_arxiv_id; c_title, c_authors, c_year, c_doi, c_arxiv_id, c_official,
    c_bibtex_url, c_priority.
    """
    q, c = F.coalesce("q_title", F.lit("")), F.coalesce("c_title", F.lit(""))
    equal = normalize_title(q, nfkc) == normalize_title(c, nfkc)
    empty = normalize_title(c, nfkc) == ""
    p = pairs.withColumns(
        {
            # titles that are equal as they are need no normal form, nor is one with a letter or digit ever empty in it
            "title_equal": equal if nfkc else F.when(q == c, True).otherwise(equal),
            "title_missing": empty if nfkc else F.when(F.regexp_like(c, F.lit("[A-Za-z0-9]")), False).otherwise(empty),
            "_qa": normalize_author(F.coalesce(F.get("q_authors", F.lit(0)), F.lit("")), nfkc),
            "_ca": normalize_author(F.coalesce(F.get("c_authors", F.lit(0)), F.lit("")), nfkc),
        }
    )
    same = lambda a, b: present(F.col(a)) & present(F.col(b)) & (F.lower(a) == F.lower(b))
    marks: list[tuple[str, Column, int]] = [
        ("title normalized exact match", F.col("title_equal"), K.TITLE_SCORE),
        ("year match", F.coalesce(F.col("q_year") == F.col("c_year"), F.lit(False)), K.YEAR_SCORE),
        ("first author match", same_author(F.col("_qa"), F.col("_ca")), K.AUTHOR_SCORE),
        ("official record", F.coalesce("c_official", F.lit(False)), K.OFFICIAL_SCORE),
        ("official bibtex endpoint candidate", present(F.col("c_bibtex_url")), K.BIBTEX_SCORE),
    ]
    total = sum((F.when(c, n).otherwise(0) for _, c, n in marks), F.lit(0)) - F.greatest(F.coalesce("c_priority", F.lit(5)) - 1, F.lit(0))
    trace = F.filter(F.array(*(F.when(c, F.lit(t)) for t, c, _ in marks)), lambda x: x.isNotNull())
    exact_doi, exact_arxiv = same("q_doi", "c_doi"), same("q_arxiv_id", "c_arxiv_id")
    return p.withColumns(
        {
            "score": F.when(exact_doi, K.DOI_SCORE).when(exact_arxiv, K.ARXIV_SCORE).otherwise(total).cast("int"),
            "trace": F.when(exact_doi, F.array(F.lit("doi exact match"))).when(exact_arxiv, F.array(F.lit("arxiv id exact match"))).otherwise(trace),
        }
    ).drop("_qa", "_ca")


#: What makes two candidates of a query equal, so that a copy of the best one is no near tie.
IDENTITY = ["c_source", "c_title", "c_authors", "c_year", "c_doi", "c_arxiv_id", "c_url", "c_official", "c_bibtex_url", "c_priority"]


def best(scored: DataFrame) -> DataFrame:
    """Adds top_score, rank (1 for the best candidate, the first of equals; 2 for others) and near_tie.

    One aggregate keeps a query's best, summed up before the shuffle, and joins back to the candidates; so a query with
    very many candidates is no single task, as it would be in a window. Candidates are told apart by 128 bits of hashes of
    all their fields, so that no title travels along.
    """
    own = [c for c in IDENTITY if c in scored.columns]
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in own))  # hashes pass nulls over
    scored = scored.withColumn("_same", F.struct(F.xxhash64(nulls, *own).alias("a"), F.xxhash64(F.lit(1), nulls, *own).alias("b")))
    same = F.col("_same")
    top = scored.groupBy("query_id").agg(F.max_by(F.struct(F.col("ord").alias("ord"), same.alias("same")), F.struct("score", -F.col("ord"))).alias("_t"), F.max("score").alias("top_score"))
    out = scored.join(top, "query_id").withColumn("rank", F.when((F.col("score") == F.col("top_score")) & (F.col("ord") == F.col("_t.ord")), 1).otherwise(2))
    return out.withColumn("near_tie", (F.col("top_score") - F.col("score") <= K.NEAR_TIE) & ~same.eqNullSafe(F.col("_t.same"))).drop("_t", "_same")


def close(ranked: DataFrame) -> DataFrame:
    """The best candidates and their near ties."""
    return ranked.where((F.col("rank") == 1) | F.col("near_tie"))


def conflicts(ranked: DataFrame) -> DataFrame:
    """query_id, code, evidence: what the best candidate and its near ties disagree on, as sorted distinct values."""
    official = F.col("c_official") & present(F.col("c_url"))
    values = F.array(
        F.struct(F.lit("DOI_CONFLICT").alias("code"), or_none(F.lower("c_doi")).alias("value")),
        F.struct(F.lit("MULTIPLE_OFFICIAL_RECORDS").alias("code"), F.when(official, F.col("c_url")).alias("value")),
    )
    rows = close(ranked).select("query_id", F.explode(values).alias("x")).select("query_id", "x.*").where("value is not null").distinct()
    return rows.groupBy("query_id", "code").agg(F.array_sort(F.collect_list("value")).alias("evidence")).where(F.size("evidence") > 1)


def decide(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One decision for each query: decision, status, score, issue (null if selected), candidate ord and conflict counts,
    evidence of the issue, trace, and the authority (source, record_url, record_type, source_priority, bibtex_url) that
    was selected.

    Conflicts are distinct counts over the best and its near ties; all is pre-aggregated before the shuffle.
    """
    for c in ("c_priority", "c_pending", "c_arxiv_id", "c_bibtex_url", "c_url", "c_doi", "c_source", "c_title", "q_title", "trace"):
        if c not in ranked.columns:
            ranked = ranked.withColumn(c, F.lit(None).cast({"c_priority": "int", "c_pending": "boolean", "trace": "array<string>"}.get(c, "string")))
    near = (F.col("rank") == 1) | F.col("near_tie")
    # titles go along only where they are evidence
    wrong = present(F.col("q_title")) & ~F.col("title_equal") & ~F.col("title_missing")
    titles = F.when(wrong, F.array("c_title", "q_title"))
    place = F.coalesce(or_none(F.col("c_url")), F.when(F.col("rank") == 1, or_none(F.col("c_title"))))
    own = ["ord", "title_equal", "title_missing", "c_official", "c_bibtex_url", "c_arxiv_id", "c_pending", "c_url", "c_doi", "c_source", "c_priority", "trace"]
    top = F.struct(*own, present(F.col("q_title")).alias("asked"), titles.alias("titles"), place.alias("place"))
    agg = ranked.groupBy("query_id").agg(
        F.max("score").alias("score"),
        F.first(F.when(F.col("rank") == 1, top), ignorenulls=True).alias("top"),
        F.count_distinct(F.when(near & present(F.col("c_doi")), F.lower("c_doi"))).alias("n_dois"),
        F.count_distinct(F.when(near & F.col("c_official") & present(F.col("c_url")), F.col("c_url"))).alias("n_official"),
    )
    d = queries.select("query_id").join(agg, "query_id", "left")
    top, asked = F.col("top"), F.col("top.asked")
    issue = (
        F.when(F.col("score").isNull(), "NO_CANDIDATES")
        .when(F.col("n_dois") > 1, "DOI_CONFLICT")
        .when(F.col("n_official") > 1, "MULTIPLE_OFFICIAL_RECORDS")
        .when(F.col("score") < K.ACCEPTED_SCORE, "LOW_CONFIDENCE")
        .when(asked & top["title_missing"], "AUTHORITY_TITLE_MISSING")
        .when(asked & ~top["title_equal"], "AUTHORITY_TITLE_MISMATCH")
        .when(F.coalesce(top["c_pending"], F.lit(False)), "OFFICIAL_RECORD_PENDING")
    )
    status = (
        F.when(F.col("issue").isin("DOI_CONFLICT", "MULTIPLE_OFFICIAL_RECORDS"), "ambiguous")
        .when(F.col("issue") == "OFFICIAL_RECORD_PENDING", "official_record_pending")
        .when(F.col("issue").isNotNull(), "unresolved")
        .when(top["c_official"] & present(top["c_bibtex_url"]), "verified_official_bibtex")
        .when(present(top["c_arxiv_id"]), "arxiv_fallback_verified")
        .otherwise("verified_manual_fallback")
    )
    kind = F.when(present(top["c_arxiv_id"]) & ~present(top["c_bibtex_url"]), "preprint_record").when(top["c_official"], "conference_proceedings").otherwise("fallback_metadata")
    authority = F.struct(top["c_source"].alias("source"), F.coalesce(top["c_url"], F.lit("")).alias("record_url"), kind.alias("record_type"), top["c_priority"].alias("source_priority"), top["c_bibtex_url"].alias("bibtex_url"))
    evidence = (
        F.when(F.col("issue").isin("LOW_CONFIDENCE", "OFFICIAL_RECORD_PENDING"), F.array(top["place"]))
        .when(F.col("issue") == "AUTHORITY_TITLE_MISSING", F.array(first_present(top["c_url"], top["c_doi"], top["c_source"])))
        .when(F.col("issue") == "AUTHORITY_TITLE_MISMATCH", top["titles"])
    )
    more = F.create_map(*(F.lit(x) for kv in {"AUTHORITY_TITLE_MISSING": "authority title missing", "AUTHORITY_TITLE_MISMATCH": "authority title mismatch", "OFFICIAL_RECORD_PENDING": "official record pending"}.items() for x in kv))
    trace = F.coalesce(top["trace"], F.array().cast("array<string>"))
    d = d.withColumn("issue", issue).withColumn("status", status)
    return d.select(
        "query_id", F.when(F.col("issue").isNull(), "selected").otherwise("blocked").alias("decision"), "status", F.coalesce("score", F.lit(0)).alias("score"), "issue", top["ord"].alias("candidate_ord"),
        F.coalesce("n_dois", F.lit(0)).alias("n_dois"), F.coalesce("n_official", F.lit(0)).alias("n_official"), evidence.alias("evidence"),
        F.filter(F.array_append(trace, F.try_element_at(more, F.col("issue"))), lambda x: x.isNotNull()).alias("trace"), F.when(F.col("issue").isNull(), authority).alias("authority"),
    )


#: What ``decide`` says in few columns.
DECISION = ["query_id", "decision", "status", "score", "issue", "candidate_ord", "n_dois", "n_official"]


def fixture_matrix(queries: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """total, ok, blocking, missing_sets (queries without candidates), placeholders (records that only stand for others)."""
    d = decisions.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("issue").isNull()).alias("ok"), F.count_if(F.col("issue").isNotNull()).alias("blocking"), F.count_if(F.col("issue") == "NO_CANDIDATES").alias("missing_sets"))
    fixture = F.try_element_at("raw", F.lit("fixture_status")) == "placeholder" if "raw" in candidates.columns else F.lit(False)
    n = candidates.join(queries.select("query_id").distinct(), "query_id", "left_semi").where(F.startswith(F.coalesce("c_url", F.lit("")), F.lit("https://example.org/")) | F.coalesce(fixture, F.lit(False)))
    one = F.lit(1).alias("_one")
    return d.select("*", one).join(n.agg(F.count(F.lit(1)).alias("placeholders")).select("*", one), "_one").drop("_one")


def stacked(*frames: DataFrame) -> DataFrame:
    """Candidates of several origins (files, saved pages, live lookups) in that order, with one running ord for each query."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_from", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy("query_id").orderBy("_from", "ord")
    return out.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).drop("_from")
