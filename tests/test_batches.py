"""Python workers are handed texts by bytes, not by rows alone."""

import pandas as pd
from pyspark.sql import functions as F

from provlake import session


def test_batches_go_by_bytes(spark, tmp_path):
    spark.range(4000).select("id", F.repeat(F.lit("x"), 10_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    @F.pandas_udf("long")
    def handed(s: pd.Series) -> pd.Series:
        return pd.Series([int(s.str.len().sum())] * len(s))

    most = session.table(spark, str(tmp_path), "documents").select(handed("text").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * session.BATCH
