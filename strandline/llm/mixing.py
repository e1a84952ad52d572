"""Mixing of sources to target weights, as a curriculum.

Source s shall give share(s) * total tokens, with a weight that changes over training time t from 0 to 1:
w(s, t) = share(s) * (1 + tilt(s) * (1 - 2 t)), whose integral over all t is the share; tilts are centred so that the
weights of all sources sum to 1 at any time. A source's documents stand in a hashed order, repeated round by round; the
tokens before a document are the demand that must have arisen when its turn comes, so the inverse of the integrated
weight gives its time, and sorting by range on time gives the order of training. A source ends when its demand is met or
its documents have been used max_repeats times.

The running sum of tokens is taken in two steps, over sums of hash buckets and within a bucket, so a source with a third
of all documents is no single task's work.

Defined results: sources compare without case and surrounding blanks; documents without source or target, or without
tokens, are not used but reported; a source without documents is reported with nothing given; repeated targets count
once (the largest); null shares count as 0, null or negative repeats as 1; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import blank_trim, cut
from .encoding import TOKENIZERS, count_tokens

#: How far the weight of the smallest source rises, and that of the largest falls, over time.
TILT = 0.5
ROWS_PER_BUCKET = 20_000


def _source(c: str):
    return F.lower(blank_trim(F.col(c)))


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """A row a source: what there is, what is wanted, how many rounds it takes, and its tilt. total: tokens of the whole mix, by default as many as the targets' sources hold."""
    have = sized.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("documents"), F.sum("n_tokens").alias("available"))
    want = targets.where("source is not null").groupBy(_source("source").alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.when(F.col("max_repeats") > 0, F.col("max_repeats")).otherwise(1)).alias("max_repeats"))
    both = want.join(have, "source", "full").fillna(0, ["target_share", "max_repeats", "documents", "available"])
    everything = Window.partitionBy(F.lit(1))  # one row a source
    size = F.lit(total).cast("double") if total is not None else F.sum(F.when(F.col("target_share") > 0, F.col("available")).otherwise(0)).over(everything).cast("double")
    both = both.withColumn("total", size).withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("capacity", F.col("available") * F.col("max_repeats"))
    both = both.withColumn("planned", F.least("wanted", F.col("capacity").cast("double")))
    order = F.percent_rank().over(everything.orderBy(F.col("target_share").desc(), "source"))
    both = both.withColumn("_r", order)
    centre = F.sum(F.col("_r") * F.col("target_share")).over(everything) / F.greatest(F.sum("target_share").over(everything), F.lit(1e-12))
    return both.withColumn("tilt", F.lit(TILT) * (centre - F.col("_r"))).drop("_r").withColumn("rounds", F.when(F.col("available") > 0, F.least(F.col("max_repeats"), F.ceil(F.col("planned") / F.col("available")))).otherwise(0).cast("int"))


def _time(q, tilt):
    """Inverse of (1 + a) t - a t^2 for q in 0..1."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * q))
    return F.when(F.abs(tilt) < 1e-9, q).otherwise(2 * q / ((1 + tilt) + root))


def mix(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(position, time, source, doc_id, copy, n_tokens): the mix in training order. position: tokens of the mix before it, as planned."""
    rows = sized.where("n_tokens > 0").join(F.broadcast(planned.select("source", "wanted", "planned", "rounds", "tilt", "total").where("rounds > 0")), "source")  # one row a source
    buckets = F.greatest(F.lit(1), F.ceil(F.lit(sized.count() / ROWS_PER_BUCKET))).cast("int")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("_h", F.xxhash64("doc_id", "copy"))
    copies = copies.withColumn("_bucket", F.floor((F.shiftrightunsigned("_h", 32).cast("double") / F.lit(2.0**32)) * buckets).cast("int"))
    sums = copies.groupBy("source", "copy", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("copy", "_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    bases = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("source", "copy", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, ["source", "copy", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_in"))
    used = placed.where(F.col("_start") + F.col("n_tokens") / 2 <= F.col("planned"))
    q = F.least(F.lit(1.0), F.col("_start") / F.col("wanted"))
    timed = used.withColumn("time", _time(q, F.col("tilt")))
    return timed.select(F.floor(F.col("time") * F.col("total")).cast("bigint").alias("position"), "time", "source", "doc_id", "copy", "n_tokens").orderBy("time", "source", "doc_id", "copy")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Targets against what the mix holds, of every source."""
    given = mixed.groupBy("source").agg(F.sum("n_tokens").alias("given"), F.count("*").alias("uses"), F.max("copy").alias("_c"))
    rows = planned.join(given, "source", "left").fillna(0, ["given", "uses"])
    everything = Window.partitionBy(F.lit(1))  # one row a source
    return rows.select(
        "source", "target_share", "max_repeats", "documents", "available", F.round("wanted").cast("bigint").alias("wanted"), "given", "uses", (F.coalesce(F.col("_c"), F.lit(-1)) + 1).alias("most_copies"),
        F.when(F.sum("given").over(everything) > 0, F.col("given") / F.sum("given").over(everything)).otherwise(0.0).alias("actual_share"),
        (F.col("wanted") <= F.col("capacity")).alias("target_can_be_met"),
    )


def sized_documents(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens), source in plain form, computed once."""
    return cut(count_tokens(documents, folder).select("doc_id", _source("source").alias("source"), "n_tokens"))
