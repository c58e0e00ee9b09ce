"""Session helper and table loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "provlake", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


#: Bytes of rows that a Python worker is handed at once: texts differ in length too much to be counted by rows.
BATCH = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def light_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that a worker's memory doesn't go by how many long texts a partition holds.

    A session's own bound stays.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; columns are pruned by whoever selects from it."""
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a session of one machine may take a folder of its own where that is unset: a cluster's must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed, its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df computed into a table of the shared folder, whose size the optimizer knows."""
    import uuid

    at = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of input, as they lie in their files, that a task which makes many rows of each is to hold.
DEAL = 8 << 20


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df by hash of columns, in partitions whose number grows with what its plan is said to read.

    The number is given, so that the adaptive plan doesn't merge partitions that are small only until rows are made of them.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    # files tell their size; what is said of computed rows is a product of guesses
    size = sum(int(x.stats().sizeInBytes()) for x in leaves if x.getClass().getSimpleName() == "LogicalRelation")
    return df.repartition(max(least, min(-(-size // DEAL), 20_000)), *columns)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package where their PYTHONPATH lacks it; once for each context."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    there = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(top) in there or getattr(context, "_provlake_shipped", False):
        return
    made = os.path.join(tempfile.mkdtemp(prefix="provlake-ship-"), "provlake_pkg.zip")
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted((top / "provlake").rglob("*.py")):
            z.write(p, p.relative_to(top))
    context.addPyFile(made)
    context._provlake_shipped = True
