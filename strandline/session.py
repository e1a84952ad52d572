"""Session set-up and the ways in which jobs cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of this machine in local mode only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, and a lost executor costs a re-read only.

    Parquet, unlike checkpoint(), compresses and lets later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def drop_cut(df: DataFrame) -> None:
    """Removes what cut() wrote for this very DataFrame; later reads of it fail."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def blank_trim(c: Column) -> Column:
    """c without surrounding white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def skew_safe_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", share: float = 0.02) -> DataFrame:
    """Join of rows to lookup, which must be unique on keys, whatever the skew of rows.

    Keys that hold at least `share` of all rows are at most 1/share in number, so their lookup rows (as many at most)
    are broadcast and the hot rows stay where they are; all others take the ordinary join. Rows with a null key
    behave as in any equi-join. how: "inner" or "left".
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = [r[:-1] for r in sizes.where((F.col("_n") >= F.lit(max(1000.0, share * total)))).collect()] if total >= 1000 else []
    if not hot:
        return rows.join(lookup, keys, how)
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    hot_keys = rows.sparkSession.createDataFrame(hot, schema)
    is_hot = hot_keys.withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(is_hot), keys, "left")  # at most 1/share rows
    hot_lookup = lookup.join(F.broadcast(hot_keys), keys, "left_semi")  # unique on keys: at most 1/share rows
    hot_part = marked.where("_hot").drop("_hot").join(F.broadcast(hot_lookup), keys, how)
    cold_part = marked.where("_hot is null").drop("_hot").join(lookup, keys, how)
    return hot_part.unionByName(cold_part)
