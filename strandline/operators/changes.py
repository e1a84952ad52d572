"""What a change set touches: diff lines, the symbols that hold them, and their joint impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .impact import impact_nodes, scores


def parse_diff(texts: DataFrame) -> DataFrame:
    """(diff_id, file_path, line) of unified diffs in (diff_id, text); a deletion marks the line it follows."""
    lines = texts.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    # fixed values: the lines of the unified diff format
    header = F.when(F.col("line").rlike(r"^diff --git a/.*? b/.*"), F.regexp_extract("line", r"^diff --git a/.*? b/(.*)$", 1))
    in_order = Window.partitionBy("diff_id").orderBy("pos")
    at = lines.withColumn("file_path", F.last(header, ignorenulls=True).over(in_order))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hits = at.where(F.col("line").rlike(hunk) & F.col("file_path").isNotNull())
    start = F.regexp_extract("line", hunk, 1).cast("int")
    count = F.when(F.regexp_extract("line", hunk, 2) == "", 1).otherwise(F.regexp_extract("line", hunk, 2).cast("int"))
    return hits.select("diff_id", "file_path", F.explode(F.sequence(start, start + F.greatest(F.lit(1), count) - 1)).alias("line")).distinct()


def touched(changed: DataFrame, nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """(diff_id, id): symbols, modules aside, in whose lines a changed line lies.

    An interval join on (file, bucket of lines), so one long file does not meet all of its lines with all of its symbols.
    """
    spans = nodes.where("kind <> 'module' and line_start is not null and line_end >= line_start").select("id", "file_path", "line_start", "line_end")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / bucket), F.floor(F.col("line_end") / bucket))))
    points = changed.select("diff_id", "file_path", "line", F.floor(F.col("line") / bucket).alias("bucket")).distinct()
    return points.join(spans, ["file_path", "bucket"]).where("line between line_start and line_end").select("diff_id", "id").distinct()


def impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """One row a diff: the highest score, raised by 10 % a symbol if several are touched, and what is reached in all.

    What several symbols of a diff reach is reduced to distinct rows before it is counted or listed.
    """
    hit = cut(touched(changed, nodes))
    roots = hit.select(F.col("id").alias("root")).distinct()
    reached = cut(impact_nodes(nodes, edges, roots, max_depth))
    each = hit.join(scores(reached, nodes, roots), F.col("id") == F.col("root")).groupBy("diff_id").agg(F.count("*").alias("symbols"), F.max("score").alias("highest"))
    met = hit.join(reached, F.col("id") == F.col("root")).select("diff_id", "node_id", "name", "file_path", "category", "direction")
    total = met.select("diff_id", "node_id").union(hit.select("diff_id", "id")).distinct().groupBy("diff_id").agg(F.count("*").alias("total_impacted"))
    held = hit.join(nodes.select("id", "file_path"), "id").select("diff_id", "file_path")
    listed = lambda rows, column, name: rows.where(F.col(column).isNotNull()).select("diff_id", column).distinct().groupBy("diff_id").agg(F.array_sort(F.collect_list(column)).alias(name))
    files = listed(met.select("diff_id", "file_path").union(held).union(changed.select("diff_id", "file_path")), "file_path", "affected_files")
    label = met.where("direction = 'up'").withColumn("label", F.concat("name", F.lit(" ("), "file_path", F.lit(")")))
    points, tests = (listed(label.where(F.col("category") == c), "label", f"affected_{name}") for c, name in (("CRITICAL", "entrypoints"), ("TEST", "tests")))
    out = files.join(each, "diff_id", "left").join(total, "diff_id", "left").join(points, "diff_id", "left").join(tests, "diff_id", "left").fillna(0, ["symbols", "highest", "total_impacted"])
    raised = F.when(F.col("symbols") > 1, F.least(F.lit(100.0), F.bround(F.col("highest") * (1 + 0.1 * F.col("symbols")), 1))).otherwise(F.col("highest"))
    none = F.array().cast("array<string>")
    return out.select("diff_id", "symbols", raised.alias("score"), "affected_files", F.coalesce("affected_entrypoints", none).alias("affected_entrypoints"), F.coalesce("affected_tests", none).alias("affected_tests"), "total_impacted")


def gate(scored: DataFrame, max_risk: float) -> DataFrame:
    """Diffs whose score is over the limit."""
    return scored.where(F.col("score") > max_risk)
