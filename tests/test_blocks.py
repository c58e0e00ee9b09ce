"""Pages are cut once, whatever the number of their lines."""

import time

from pyspark.sql import functions as F

from provlake.sources import parsers


def took(spark, lines: int, rows: int) -> float:
    text = F.concat(F.lit("[page 1]\n"), F.repeat(F.lit("some words of a line\n"), lines))
    t = spark.range(rows).select(F.col("id").alias("path"), text.alias("text"))
    began = time.perf_counter()
    assert parsers.blocks(t).agg(F.count("label"), F.count("text")).first()[0] == lines * rows
    return time.perf_counter() - began


def test_work_goes_by_lines(spark):
    took(spark, 10, 10)
    # the same lines in all, in long pages and in short ones
    assert took(spark, 4000, 4) < 10 * took(spark, 40, 400)


def test_a_page_keeps_its_labels(spark):
    text = "[page iv]\none\ntwo\n[page 2]\nonly\n[page 3]\na\n\nb\nc"
    got = parsers.blocks(spark.createDataFrame([(1, text), (2, "plain\n\n[page 4] inline"), (3, None), (4, "")], "path long, text string"))
    assert [tuple(r) for r in got.orderBy("path", "block_ord").collect()] == [
        (1, 0, "page iv paragraph 1", "one"), (1, 1, "page iv paragraph 2", "two"), (1, 2, "page 2", "only"), (1, 3, "page 3 paragraph 1", "a"), (1, 4, "page 3 paragraph 2", "b c"),
        (2, 0, "paragraph 1", "plain"), (2, 1, "page 4", "inline"),
    ]
