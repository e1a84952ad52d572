"""Source files that do not parse, by packrat grammars that must consume a whole file.

Nothing is shuffled but the verdicts; texts are not kept from one file to the next.

Defined results: null and empty contents and files of comments only are valid; an unknown or missing extension gives no
verdict (valid is null); nesting of any depth is parsed; repeated rows give one verdict; columns beyond those named are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import LANGUAGE_OF, LexError, extension, tokens
from .docpairs import description, documentation, functions, says_nothing
from .grammars import grammar

#: Python frames that a parse may need at first, and for each token of a deeply nested text.
DEPTH, FRAMES = 20_000, 40
_CONFLICT = re.compile(r"^(?:<{7}|>{7})(?: |\r?$)", re.M)
#: Extensions that stand for the others of their language where another language is tried.
TRIED = ("py", "js", "tsx", "ts", "java", "go", "rs")


def spread(df: DataFrame) -> DataFrame:
    """df in at least two partitions a core: few large files would leave cores idle in what follows, which is all CPU."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def _deep(work, size: int):
    """What work() gives, with as many frames as a text of so many tokens can need."""
    try:
        return work()
    except RecursionError:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, FRAMES * size + DEPTH))
        try:
            return work()
        finally:
            sys.setrecursionlimit(before)


def parse(content: str, ext: str):
    """(tokens, nodes) of a valid text; raises LexError or returns (tokens, None) for others."""
    t = _deep(lambda: tokens(content, ext), len(content))
    return t, _deep(lambda: grammar(ext).parse(t.kinds), len(t.kinds))


def is_valid(content: str | None, ext: str) -> bool | None:
    if ext not in LANGUAGE_OF:
        return None
    try:
        return not content or parse(content, ext)[1] is not None
    except LexError:
        return False


def verdict(content: str | None, ext: str) -> tuple:
    """(valid, furthest offset, cause, tokens wanted there)."""
    if ext not in LANGUAGE_OF:
        return None, None, None, None
    if not content:
        return True, None, None, None
    try:
        t, nodes = parse(content, ext)
    except LexError as e:
        return False, min(e.at, len(content)), _cause(content, ext, e.at, e.cause), None
    if nodes is not None:
        return True, None, None, None
    at, wanted = _deep(lambda: grammar(ext).furthest(t.kinds), len(t.kinds))
    return False, t.starts[at], _cause(content, ext, t.starts[at], "syntax"), " ".join(wanted)


def _cause(content: str, ext: str, at: int, cause: str) -> str:
    """A conflict's markers, wherever they stand; a text of another language; an end too early; else what stopped the parse."""
    if _CONFLICT.search(content):
        return "merge conflict"
    if any(LANGUAGE_OF[e] != LANGUAGE_OF[ext] and is_valid(content, e) for e in TRIED):
        return "wrong extension"
    return "truncated" if not content[at:].strip() else cause


def _settle() -> None:
    """Parsing makes many short-lived tuples and no cycles, so the collector may look less often."""
    sys.setrecursionlimit(DEPTH)
    gc.set_threshold(100_000, 50, 100)


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _settle()
    for b in batches:
        rows = []
        for path, content in zip(b["file_path"], b["content"]):
            ext = extension(path)
            ok, at, cause, wanted = verdict(content, ext)
            rows.append((LANGUAGE_OF.get(ext), ok, at, None if at is None else content.count("\n", 0, at) + 1, cause, wanted))
        out = pd.DataFrame(rows, columns=["language", "valid", "failed_at", "failed_line", "cause", "wanted"], dtype=object)
        yield pd.concat([b[["file_id", "repo_id"]].reset_index(drop=True), out], axis=1)


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _settle()
    for b in batches:
        exts = [extension(p) for p in b["file_path"]]
        yield pd.DataFrame({"file_id": b["file_id"], "repo_id": b["repo_id"], "language": [LANGUAGE_OF.get(e) for e in exts], "valid": pd.array([is_valid(c, e) for c, e in zip(b["content"], exts)], dtype="boolean")})


def answers(files: DataFrame) -> DataFrame:
    """One row a row of files: its language and whether it parses, without the reason."""
    rows = spread(files.select("file_id", "repo_id", "file_path", "content"))
    return rows.mapInPandas(_answers, "file_id bigint, repo_id int, language string, valid boolean")


def verdicts(files: DataFrame) -> DataFrame:
    """One row a row of files, with the verdict on its content."""
    rows = spread(files.select("file_id", "repo_id", "file_path", "content"))
    return rows.mapInPandas(_verdicts, "file_id bigint, repo_id int, language string, valid boolean, failed_at int, failed_line int, cause string, wanted string")


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language, each file once."""
    once = judged.groupBy("file_id").agg(F.first("repo_id").alias("repo_id"), F.first("language").alias("language"), F.bool_and("valid").alias("valid"))
    return once.where("valid is not null").groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))


def may_document(path: Column, content: Column) -> Column:
    """Whether a text holds what documentation of its language looks like: without that it has no documented function."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    opens_a_body = content.rlike(r":(?:[ \t\f\r\n]|\\\r?\n|#[^\n]*\n)*+[rRuU]?[\"']")
    above_func = content.rlike(r"(?://[^\n]*\n|\*/[ \t\r]*\n?)[ \t]*func\b")
    return F.when(ext == "py", opens_a_body).when(ext == "go", above_func).when(ext == "rs", content.contains("///") | content.contains("/**") | content.contains("doc")).otherwise(content.contains("/**"))


def _pairs(batches: Iterator[pd.DataFrame], with_code: bool = True) -> Iterator[pd.DataFrame]:
    _settle()
    for b in batches:
        rows = []
        for file_id, repo_id, path, content in zip(b["file_id"], b["repo_id"], b["file_path"], b["content"]):
            ext = extension(path)
            if content and ext in LANGUAGE_OF:
                rows += [(file_id, repo_id, *x) for x in _documented(content, ext, with_code)]
        yield pd.DataFrame(rows, columns=["file_id", "repo_id", "language", "qualified_name", "kind", "line_start", "line_end", "description", "code"][: None if with_code else 5])


def _documented(content: str, ext: str, with_code: bool = True):
    try:
        t, nodes = parse(content, ext)
    except LexError:
        return
    language = LANGUAGE_OF[ext]
    for name, what, first, at, end in functions(t, nodes or [], language):
        doc = documentation(t, language, first, at, end)
        text = description(doc) if doc else ""
        if text and not says_nothing(text, name):
            if not with_code:
                yield language, name, what
                continue
            last = end - 1
            while last > first and not content[t.starts[last] : t.ends[last]].strip():
                last -= 1
            yield language, name, what, content.count("\n", 0, t.starts[first]) + 1, content.count("\n", 0, t.ends[last]) + 1, text, content[t.starts[first] : t.ends[last]]


def pairs(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Every documented function of every file that parses; with_code: with its lines, description and code."""
    rows = spread(files.select("file_id", "repo_id", "file_path", "content")).where(may_document(F.col("file_path"), F.col("content")))
    schema = "file_id bigint, repo_id int, language string, qualified_name string, kind string"
    if with_code:
        return rows.mapInPandas(_pairs, schema + ", line_start int, line_end int, description string, code string")
    return rows.mapInPandas(lambda batches: _pairs(batches, False), schema)
