"""Finding symbols and looking at their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: 100, 80, 60 and 40 for a name, and what holds the text in its qualified name, name or path.
def find_symbols(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Best matches by name, qualified name and path; ties by name, then position."""
    q = query.lower().strip()
    lower = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "qualified_name", "file_path")]
    score = F.when(lower[0] == q, 100).when(lower[1].contains(q), 80).when(lower[0].contains(q), 60).when(lower[2].contains(q), 40).otherwise(0)
    rows = nodes if q.startswith("module:") else nodes.where("kind <> 'module'")
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    scored = rows.withColumn("match_score", score).where((F.col("match_score") > 0) | F.lit(not q))
    return scored.orderBy(F.desc("match_score"), "name", "node_seq", "id").limit(limit).select("id", "name", "qualified_name", "kind", "file_path", "match_score")


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def _fits(query: Column) -> Column:
    return (F.col("qualified_name") == query) | F.endswith("qualified_name", F.concat(F.lit("."), query)) | (F.col("name") == query)


def resolve(nodes: DataFrame, queries: DataFrame, prefer_code: bool = True) -> DataFrame:
    """(query, id): the symbol that each query names, by id, else by qualified name, its end, or name.

    Equi-joins on every end of the qualified name; prefer_code puts files without "test" in their path first.
    """
    exact = queries.select("query").distinct().join(nodes.select(F.col("id").alias("query")), "query").withColumn("id", F.col("query"))
    rest = queries.select("query").distinct().join(exact.select("query"), "query", "left_anti").withColumn("key", F.trim("query"))
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = nodes.where("kind <> 'module' and qualified_name is not null").select("id", "node_seq", "file_path", F.explode(F.array_distinct(F.array_append(ends, F.col("name")))).alias("key"))
    order = F.struct((F.lower("file_path").contains("test") if prefer_code else F.lit(False)).alias("t"), "node_seq", "id")
    found = rest.join(keys, "key").groupBy("query").agg(F.min(order).alias("o")).select("query", F.col("o.id").alias("id"))
    return exact.select("query", "id").unionByName(found)


def filter_list(nodes: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Symbols whose qualified name or path holds the text, by qualified name."""
    t = text.lower()
    fits = F.lower("qualified_name").contains(t) | F.lower("file_path").contains(t)
    return nodes.where(fits).orderBy("qualified_name", "node_seq", "id").limit(limit).select("id", "qualified_name", "kind", "file_path")


def source_preview(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source): the lines of each symbol in its file, joined on path."""
    text = files.select(F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path"), "content").dropDuplicates(["file_path"])
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")
    rows = nodes.where("line_start is not null and line_end >= line_start").select("id", "file_path", "line_start", "line_end").join(text, "file_path")
    return rows.select("id", "line_start", "line_end", F.array_join(F.slice(lines, F.greatest(F.col("line_start"), F.lit(1)), F.col("line_end") - F.col("line_start") + 1), "\n").alias("source"))
