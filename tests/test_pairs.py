"""Pairs of claims and blocks are made where the block lies: nothing that grows with the pairs is shuffled."""

from pyspark.sql import functions as F

from provlake.operators import claim_sources, evidence
from provlake.sources import parsers

WORDS = "alpha bravo charlie delta echoes foxtrot golfing hotels indigo juliet".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    """Three claims; a key cited twice, one without sources; sources that can't be read or share no term."""
    claims = spark.createDataFrame([(0, "c0", "alpha bravo charlie", "en, en"), (1, "c1", "delta echoes", "fr; en"), (2, "c2", "golfing", "xx")], "ord int, claim_id string, claim_text string, citation_key string").withColumn("quote_or_evidence", F.lit(""))
    sm = spark.createDataFrame([("en", "p", "a", "full", 0), ("en", "q", "b", "full", 1), ("fr", "p", "c", "abstract", 2), ("fr", "gone", "d", "full", 3)], "citation_key string, source_text string, source_label string, evidence_kind string, ord int")
    texts = spark.createDataFrame([("p", "alpha bravo\n\nalpha bravo charlie delta"), ("q", "none alike"), ("unmapped", "alpha bravo charlie")], "path string, text string")
    return claims, sm, texts


def test_pairs_are_not_shuffled(spark):
    claims = spark.range(20).select(F.lit(0).alias("scope"), F.col("id").alias("claim_id"), F.lit(" ".join(WORDS)).alias("text"))
    blocks = spark.range(50).select(F.lit(0).alias("scope"), F.col("id").alias("block_id"), F.lit(" ".join(WORDS[3:])).alias("text"))
    claims, blocks = (x.where("scope = 0") for x in (claims, blocks))
    pairs = evidence.overlap(claims, blocks)
    assert plan(pairs).count("Exchange hashpartitioning") == 1
    assert pairs.count() == 1000 and {r["overlap"] for r in pairs.collect()} == {7}


def test_claims_are_not_repeated_for_their_sources(spark, tmp_path):
    for name, t in zip(("claims", "sm", "texts"), tables(spark), strict=True):
        t.write.parquet(f"{tmp_path}/{name}")
    claims, sm, texts = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("claims", "sm", "texts"))
    found = claim_sources.matched(claims, sm, texts, False)
    assert "claim_id" not in "".join(x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x)
    best = {r["ord"]: (r["path"], r["block_ord"], r["overlap"], r["source_label"], r["text"], r["citation_key"], r["key_pos"]) for r in claim_sources.best_sources(claims, sm, texts).collect()}
    assert best == {0: ("p", 1, 3, "a", "alpha bravo charlie delta", "en", 0), 1: ("p", 1, 1, "c", "alpha bravo charlie delta", "fr", 0)}


def test_every_source_has_a_row_in_a_review(spark):
    ranks = claim_sources.review_ranks(*tables(spark), most=1)
    got = sorted((r["ord"], r["key_pos"], r["source_ord"], r["rank"], r["block_ord"], r["overlap"]) for r in ranks.collect())
    none = (None, None, None)
    assert sorted(got, key=str) == sorted([(0, 0, 0, 1, 1, 3), (0, 0, 1, *none), (0, 1, 0, 1, 1, 3), (0, 1, 1, *none), (1, 0, 2, 1, 1, 1), (1, 0, 3, *none), (1, 1, 0, 1, 1, 1), (1, 1, 1, *none)], key=str)
    whole = claim_sources.review_candidates(*tables(spark), most=1)
    assert {(r["ord"], r["source_ord"]): r["quote_or_evidence"] for r in whole.collect()}[1, 3] is None and whole.count() == len(got)


def test_blocks_of_texts_without_any(spark):
    t = spark.createDataFrame([("a", "one\n\ntwo"), ("b", ""), ("c", None)], "path string, text string")
    assert sorted((r["path"], r["block_ord"]) for r in parsers.blocks(t, every=True).collect()) == [("a", -1), ("a", 0), ("a", 1), ("b", -1), ("c", -1)]
