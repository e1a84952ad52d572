"""Source trees as tables, with a cache of what was extracted from unchanged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.lexing import LANGUAGE_OF
from ..operators.extract import extract

#: What is not looked at unless the configuration says so.
IGNORED_DIRS = (".git", ".venv", "venv", "env", "node_modules", "target", "build", "dist", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".idea", ".vscode", ".gradle", "out", "bin")
IGNORED_FILES = (".DS_Store", "Thumbs.db")
MAX_BYTES = 2 * 1024 * 1024


def language(path: Column) -> Column:
    """Language by extension, null where there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv)), ext)


def discover(files: DataFrame, root: str, ignored_dirs=IGNORED_DIRS, ignored_files=IGNORED_FILES) -> DataFrame:
    """Rows of (path, ...) below root that are source files: no ignored or dotted folder above them, no ignored name."""
    prefix = "/" + root.replace("file:", "").strip("/") + "/"
    full = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.when(full.startswith(prefix), F.substring(full, len(prefix) + 1, F.length(full))).otherwise(F.regexp_replace(full, r"^.*/", ""))
    parts = F.split("file_path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda d: d.isin(*ignored_dirs) | d.startswith("."))
    rows = files.withColumn("file_path", relative).withColumn("language", language(F.col("file_path")))
    return rows.where(F.col("language").isNotNull() & ~hidden & ~F.element_at(parts, -1).isin(*ignored_files))


def scan(spark: SparkSession, root: str, repo_id: int = 0, max_bytes: int = MAX_BYTES, **ignored) -> DataFrame:
    """(repo_id, file_path, language, content_hash, content, modified) of a source tree; size is checked before reading."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    kept = discover(raw, root, **ignored)
    return kept.select(F.lit(repo_id).alias("repo_id"), "file_path", "language", F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("modified"))


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def split_by_cache(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose hash the cache knows, and all others."""
    known = cached.select("repo_id", "file_path", "content_hash")
    keys = ["repo_id", "file_path", "content_hash"]
    return files.join(known, keys, "left_semi"), files.join(known, keys, "left_anti")


def extract_cached(spark: SparkSession, files: DataFrame, cache: str, use_cache: bool = True) -> DataFrame:
    """Extracted files, those of unchanged content from the cache, which is written anew beside the old and swapped in."""
    cached = load_cache(spark, cache) if use_cache else None
    hashes = files.select("repo_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path"), "content_hash")
    if cached is None:
        out = extract(files).join(hashes, ["repo_id", "file_path"])
    else:
        old, new = split_by_cache(files, cached)
        out = cached.join(old.select("repo_id", "file_path", "content_hash"), ["repo_id", "file_path", "content_hash"], "left_semi").unionByName(extract(new).join(hashes, ["repo_id", "file_path"]))
    fresh = cache.rstrip("/") + ".new"
    out.write.mode("overwrite").parquet(fresh)
    jvm = spark._jvm.org.apache.hadoop.fs
    a, b = jvm.Path(fresh), jvm.Path(cache)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    fs.rename(a, b)
    return spark.read.parquet(cache)
