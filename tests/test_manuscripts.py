"""Many small manuscripts are walked in batches, not one call each."""

from pyspark.sql import functions as F

from provlake.sources import parsers


def test_manuscripts_share_batches(spark):
    n = F.col("id").cast("string")
    files = spark.range(300).select(n.alias("project"), F.explode(F.array(F.struct(F.lit("main.tex").alias("path"), F.lit(r"\input{a}\input{gone}").alias("text")), F.struct(F.lit("a.tex").alias("path"), F.lit(r"\input{main}").alias("text")))).alias("f")).select("project", "f.*")
    roots = spark.range(300).select(n.alias("project"), F.lit("main.tex").alias("path"))
    sources, issues = parsers.tex_documents(files, roots)
    assert "FlatMapGroupsInPandas" not in sources._jdf.queryExecution().executedPlan().toString()
    assert {(r["project"], r["ord"], r["path"], r["depth"]) for r in sources.collect()} == {(str(i), *x) for i in range(300) for x in ((0, "main.tex", 0), (1, "a.tex", 1))}
    assert {(r["ord"], r["code"], *r["evidence"]) for r in issues.collect()} == {(2, "TEX_INCLUDE_CYCLE", "main.tex"), (3, "TEX_INCLUDE_MISSING", "gone.tex")} and issues.count() == 600
