"""Results per key when a few keys hold most rows.

Rows are range-partitioned on the composite (key, secondary order, row id): Spark samples quantiles of it, so a heavy key
is cut across as many partitions as its rows need, even where its secondary values are few and a row id is given, and no
task runs longer than the others. Each sorted partition is walked once in Arrow batches into one partial state a key: its
rows, its distinct secondary values, and the first and last of these. A key's partials, of which only the first and last of
a partition can have a sister elsewhere, are then stitched in the order of the partitions: a value that ends one partial
and begins the next counts once.

Defined results: rows with a null key count towards the table's rows and to no key; a null secondary is one value of its
own; ties in all three fall into one partition; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_PARTIAL = "key_id string, part int, n bigint, n_distinct bigint, first string, last string"


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, secondary) batches to (key, partition, n, n_distinct, first, last): runs are found by comparing neighbours."""
    part = TaskContext.get().partitionId()
    last_key = last_sec = None
    carry: list | None = None
    columns = ("key", "n", "d", "first", "last")

    def made(rows: dict[str, list]) -> pa.RecordBatch:
        arrays = [pa.array(rows["key"], pa.string()), pa.array([part] * len(rows["key"]), pa.int32()), pa.array(rows["n"], pa.int64()), pa.array(rows["d"], pa.int64()), pa.array(rows["first"], pa.string()), pa.array(rows["last"], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["key_id", "part", "n", "n_distinct", "first", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, sec = batch.column(0), batch.column(1).cast(pa.string()).fill_null("\0")
        n = len(key)
        new_key = pa.concat_arrays([pa.array([key[0].as_py() != last_key]), pc.not_equal(key.slice(1), key.slice(0, n - 1))])
        moved = pa.concat_arrays([pa.array([sec[0].as_py() != last_sec]), pc.not_equal(sec.slice(1), sec.slice(0, n - 1))])
        run = pc.cumulative_sum(new_key.cast(pa.int64()))
        t = pa.table({"run": run, "key": key, "sec": sec, "d": pc.or_(new_key, moved).cast(pa.int64())}).group_by("run", use_threads=False).aggregate([("key", "min"), ("key", "count"), ("d", "sum"), ("sec", "first"), ("sec", "last")])
        rows = {c: t[name].to_pylist() for c, name in zip(columns, ("key_min", "key_count", "d_sum", "sec_first", "sec_last"))}
        last_key, last_sec = key[n - 1].as_py(), sec[n - 1].as_py()
        if carry and rows["key"][0] == carry[0]:
            rows["n"][0], rows["d"][0], rows["first"][0] = rows["n"][0] + carry[1], rows["d"][0] + carry[2], carry[3]
        elif carry:
            for c, v in zip(columns, carry):
                rows[c].insert(0, v)
        carry = [rows[c].pop() for c in columns]
        if rows["key"]:
            yield made(rows)
    if carry:
        yield made({c: [v] for c, v in zip(columns, carry)})


def per_key(df: DataFrame, key: str, secondary: str, partitions: int | None = None, row_id: str | None = None) -> DataFrame:
    """(key_id, n, n_distinct): rows and distinct values of `secondary` (null is one) of each non-null key.

    row_id: a column that tells rows of one key and secondary value apart, where there may be very many of these.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key_id"), F.col(secondary).cast("string").alias("_by"), F.col(row_id or secondary).alias("_row"))
    ordered = rows.repartitionByRange(n, "key_id", "_by", "_row").sortWithinPartitions("key_id", "_by")
    partial = ordered.select("key_id", "_by").mapInArrow(_partials, _PARTIAL)
    # a key has at most one partial a partition
    parts = partial.groupBy("key_id").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("d"), F.sort_array(F.collect_list(F.struct("part", "first", "last"))).alias("p"))
    twice = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("p"))), F.lit(0).cast("bigint"), lambda a, i: a + F.when((i <= F.size("p")) & (F.try_element_at("p", i)["first"] == F.try_element_at("p", i - 1)["last"]), 1).otherwise(0))
    return parts.select("key_id", "n", (F.col("d") - F.when(F.size("p") > 1, twice).otherwise(0)).alias("n_distinct"))


def heavy(df: DataFrame, key: str, secondary: str, share: Column | float = 0.01) -> DataFrame:
    """Keys that hold at least `share` of all rows of df, null keys included in the rows."""
    total = df.agg(F.count("*").alias("t"))
    return per_key(df, key, secondary).where(F.col("n") >= F.lit(share) * total.scalar()).select("key_id", "n", "n_distinct")
