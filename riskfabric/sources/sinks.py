"""Table sinks (S8-S10).  Written tables are the lineage cut between jobs:
they land under the shared folder the cluster names in spark.checkpoint.dir,
never on a machine-local path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Parquet sink; ``partition_by`` lays files out by key so later reads
    prune directories (predictions by state).  Rows are clustered by key first:
    a key with many rows is cut over several tasks and small keys share one, so
    files are bounded by size and there are not as many as tasks times keys."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its plan runs once
    however often the result is read, the files tell Spark its size, and nothing
    stays cached."""
    path = write_table(df, shared_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or checkpoint of ours that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def eval_document(summary: DataFrame, operating_point_row, n_train: int, n_test: int,
                  backend: str, primary_display: str) -> DataFrame:
    """The evaluation document as one JSON row (S9): counts, one map per
    metric keyed by outcome display name, the curve's outcome and the
    operating point.  The maps aggregate the five-row summary; the PR
    curve itself stays a long table (written next to the document) rather
    than an array collected into one row."""
    from ..functions import exprs as X
    from ..functions import fixed

    keyed = summary.withColumn("_k", X.literal_lookup("target", fixed.TARGET_DISPLAY_NAMES))
    maps = keyed.agg(*[
        F.map_from_entries(F.collect_list(F.struct("_k", F.col(m)))).alias(f"{m}_by_target")
        for m in ("macro_f1", "roc_auc", "pr_auc", "prevalence")])
    op = operating_point_row
    op_struct = F.struct(
        F.lit(primary_display).alias("target"),
        F.lit(op["threshold"] if op else None).cast("double").alias("threshold"),
        F.lit(op["precision"] if op else None).cast("double").alias("precision"),
        F.lit(op["recall"] if op else None).cast("double").alias("recall"),
        F.lit(op["f1"] if op else None).cast("double").alias("f1"))
    doc = F.struct(F.lit(backend).alias("model_backend"), F.lit(int(n_train)).alias("n_train"),
                   F.lit(int(n_test)).alias("n_test"),
                   *[F.col(f"{m}_by_target") for m in ("macro_f1", "roc_auc", "pr_auc", "prevalence")],
                   F.lit(primary_display).alias("precision_recall_target"),
                   op_struct.alias("operating_point"))
    return maps.select(F.to_json(doc).alias("document"))
