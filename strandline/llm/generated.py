"""Source files that nobody wrote by hand in their repository.

A file becomes a sequence of tokens (all names one symbol, all numbers and all strings one each), and a Re-Pair grammar is
inferred over it. A rule with a definition or a condition in it that is used many times and covers the file means that a
tool wrote it; the fewer its uses, the more the file must show a counter running through it, and conditions alone must
also have made a symbol of high complexity or fill nearly all of the file. Files that are nearly all literals are data:
tables of very many literals, and long texts that a grammar over their characters shrinks hardly more than over the
same characters shuffled (prose shrinks).
Statements, word for word, are joined into rules over all files: pairs of neighbours that also occur in third-party
files, and passages, ended where a statement's own hash says so and so equal wherever they stand, that several
repositories hold. A file made of such rules is a copy. Long lines once literals are taken out are minified code. Folders
named in a repository's ignored_dirs, and header comments of tools, decide by themselves.

Defined results: null and empty contents are hand-written unless their folder is ignored; repeated rows give one row; a
repository without scan configuration ignores no folder; a null repo_id is a repository of its own; files without symbols
have no complexity; very long texts are read whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .repair import re_pair
from .syntax import spread

#: A rule must be used so often, and be so long in tokens, to say anything; below COUNTED uses a counter must run through the file.
USES, COUNTED, LENGTH = 5, 8, 5
#: Share of the file that a rule must cover: with a definition in it; with a condition in it, where a symbol is complex or not.
COVER, COVER_COMPLEX, COVER_CONDITION = 0.5, 0.5, 0.75
COMPLEX = 50
#: Share of a file's statements that lie in rules shared with one third-party file or with REPOSITORIES, and the least number of them.
COPIED, LEAST_SHARED, REPOSITORIES = 0.7, 6, 3
#: Statements a passage has on average.
PASSAGE = 8
#: Mean length of code lines without literals and blanks from which code is minified, and the share of brackets and = that prose lacks.
MINIFIED, DENSE = 110, 0.06
#: Share of the characters in literals, their number and length from which a file is data, and the size of its
#: grammar against that of its characters shuffled.
DATA_SHARE, DATA_COUNT, DATA_LENGTH, INCOMPRESSIBLE = 0.9, 100, 1500, 0.9
#: Files whose grammars are inferred together, and words remembered with their codes.
TOGETHER, KEPT_WORDS = 256, 200_000

#: How tools announce their output, at the start of a comment.
_HEADER = re.compile(
    r"(?im)^\W*(?:code generated (?:by|from|using)\b|@generated\b|<auto-?generated|(?:this (?:file|code|class|module) (?:is|was|has been) )?(?:auto-?|automatically |machine[ -])generated\b|"
    r"generated (?:from|by|with|using)\b[^\n]*\b(?:by|from|with|using|compiler|tool|generator|do not|v?\d)|this (?:file|code|class|module) (?:is|was|has been) (?:generated|produced|created) (?:by|from|with)\b|"
    r"created by the [^\n]* (?:tool|generator|compiler)\b[^\n]*(?:build|do not|by hand)|do not (?:edit|modify)\b[^\n]*\b(?:generated|overwritten|regenerated)\b)"
)
#: Words that define or case, that only ask, and all others that are no names.
_DEFINES, _ASKS = "def function func fn case public private protected void when".split(), "if elif".split()
_OTHERS = "for while return switch match try else loop class interface struct enum impl import from package use const let var new true false null None True False".split()

_STRING = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_REST = r"[^\W\d][\w$]*|\$[\w$]*|\.?\d[\w.]*|\n|[^\s\w]|\S"
#: Words of a text, comments among them, by whether # opens a comment. Strings stand before comments, so marks within them open none.
_WORDS = {False: re.compile(rf"{_STRING}|/\*.*?\*/|//[^\n]*|{_REST}", re.S), True: re.compile(rf"{_STRING}|#[^\n]*|{_REST}", re.S)}

# A word's code: its kind in the low eight bits, its hash above. Kinds are in this order.
_COMMENT, _LINE, _END, _NAME, _STRINGS, _NUMBERS, _MARK = range(7)
_FIRST_WORD = 16
_FIXED = [*_DEFINES, *_ASKS, *_OTHERS]
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[_END, *range(_MARK, _FIRST_WORD), *range(128, 256)]] = True
_IS_CODE = np.zeros(256, bool)
_IS_CODE[[_END, *(128 + ord(c) for c in "()=[]")]] = True


def _code(kind: int, word: str) -> int:
    return (xxhash.xxh64_intdigest(word) & 0x7FFFFFFFFFFFFF00) | kind


class _Codes(dict):
    """Codes of words, found once."""

    def __missing__(self, w: str) -> int:
        c = w[0]
        if c == "\n":
            kind = _LINE
        elif c in ";{}":
            kind = _END
        elif c.isalpha() or c in "_$":
            kind = _FIRST_WORD + _FIXED.index(w) if w in _FIXED else _NAME
        elif c.isdigit() or c == "." and len(w) > 1:
            kind = _NUMBERS
        elif len(w) > 1:
            kind = _STRINGS if c in "\"'`" else _COMMENT
        else:
            kind = 128 + ord(c) if ord(c) < 128 else _MARK
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[w] = code = _code(kind, w)
        return code


_CODES = _Codes()


def _mixed(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash for each run of hashes, its place in the run counting."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(h)))).astype(np.uint64)
    x = (h.astype(np.uint64) ^ (at * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    out = np.add.reduceat(x * np.uint64(0x94D049BB133111EB), starts)
    return out ^ (out >> np.uint64(32))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rules(codes: np.ndarray, file: np.ndarray, files: int) -> tuple[np.ndarray, list, list, list]:
    """Of each file's words without comments: its statements, the hashes of pairs of neighbours, and of passages with their statements."""
    kind = codes & 255
    inside = (kind != _LINE) & (kind != _END)
    words, of = codes[inside], file[inside]
    starts = _changes(of, np.cumsum(~inside)[inside])
    statements, of = _mixed(words, starts), of[starts]
    together = of[1:] == of[:-1]
    pairs = ((statements[:-1] * np.uint64(3) + statements[1:]) >> np.uint64(1)).astype(np.int64)[together]
    heads = _changes(of, np.cumsum(np.append(0, statements[:-1] % np.uint64(PASSAGE) == 0))) if len(of) else starts
    passages, sizes = (_mixed(statements, heads) >> np.uint64(1)).astype(np.int64), np.diff(np.append(heads, len(statements)))
    by_file = lambda values, of: np.split(values, np.cumsum(np.bincount(of, minlength=files))[:-1])
    return np.bincount(of, minlength=files), [np.unique(x) for x in by_file(pairs, of[1:][together])], by_file(passages, of[heads]), by_file(sizes, of[heads])


def _counts_up(words: list[str], kinds: np.ndarray) -> bool:
    """Whether a counter runs through the file: most numbers, or numbers at the ends of names, go up by one."""
    for kind in (_NUMBERS, _NAME):
        found = [m[0] for i in np.flatnonzero(kinds == kind) if (m := re.search(r"\d{1,9}$", words[i]))]
        steps = np.diff(np.array(found, dtype=np.int64)) if len(found) > USES - 1 else np.zeros(0)
        if len(steps) and (steps == 1).mean() >= 0.8:
            return True
    return False


def _blob(texts: list[str]) -> list[bool]:
    """Whether a grammar over the characters of each text is hardly smaller than one over the same characters shuffled."""
    if not any(texts):
        return [False] * len(texts)
    chars = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    both = [*chars, *(np.random.default_rng(len(c)).permutation(c) for c in chars)]
    sizes = re_pair(np.concatenate(both), np.repeat(np.arange(len(both)), [len(c) for c in both])).sizes(len(both))
    return [bool(len(c) and own >= INCOMPRESSIBLE * mixed) for c, own, mixed in zip(chars, sizes, sizes[len(chars) :])]


def features(texts: list[str], hash_comments: list[bool]) -> list[tuple]:
    """(reason, share that conditions cover, statements, pairs, passages, their statements) of each text, as far as it tells itself."""
    n = len(texts)
    words: list[str] = []
    counts = []
    for text, hashes in zip(texts, hash_comments):
        found = _WORDS[hashes].findall(text.replace("\r\n", "\n"))
        words += found
        counts.append(len(found))
    codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    file = np.repeat(np.arange(n), counts)
    reasons: list[str | None] = [None] * n
    comment = (codes & 255) == _COMMENT
    for i in np.flatnonzero(comment).tolist():
        if reasons[file[i]] is None and _HEADER.search(words[i]):
            reasons[file[i]] = "generated"
    at = np.flatnonzero(~comment)
    codes, sizes, file = codes[at], sizes[at], file[at]
    kinds = codes & 255
    literal, mark, code = (kinds == _STRINGS) | (kinds == _NUMBERS), _IS_MARK[kinds], kinds != _LINE
    total = lambda which: np.bincount(file[which], sizes[which], n)
    chars, literals, marks, many = total(code), total(literal), total(mark), np.bincount(file[literal], minlength=n)
    lines = np.bincount(file[code][_changes(file[code], np.cumsum(~code)[code])], minlength=n)
    full = (chars >= DATA_LENGTH) & (literals + marks >= DATA_SHARE * chars) & (2 * literals >= DATA_SHARE * chars)
    long_lines = (chars - literals > MINIFIED * lines) & (total(_IS_CODE[kinds]) > DENSE * (chars - literals))
    blobs = [i for i in np.flatnonzero(full & (many < DATA_COUNT)).tolist() if reasons[i] is None]
    strings = np.flatnonzero((kinds == _STRINGS) & np.isin(file, blobs)) if blobs else []
    held: dict[int, list[str]] = {i: [] for i in blobs}
    for i in strings:
        held[int(file[i])].append(words[at[i]][1:-1])
    for i, blob in zip(blobs, _blob(["".join(held[i]) for i in blobs])):
        reasons[i] = "data" if blob else None
    for i in np.flatnonzero(full & (many >= DATA_COUNT)).tolist():
        reasons[i] = reasons[i] or "data"
    for i in np.flatnonzero(long_lines).tolist():
        if reasons[i] is None and not texts[i].lstrip().startswith("<"):
            reasons[i] = "minified"
    conditions = _repeated(reasons, words, at[code], kinds[code], file[code])
    return list(zip(reasons, conditions, *_rules(codes, file, n)))


def _repeated(reasons: list[str | None], words: list[str], at: np.ndarray, kinds: np.ndarray, file: np.ndarray) -> list[float]:
    """Sets the reason of files that one rule of their grammar covers; gives the share that conditions cover of each."""
    conditions, counts = [0.0] * len(reasons), np.bincount(file, minlength=len(reasons))
    if not len(kinds):
        return conditions
    grammars = re_pair(kinds, file, USES)
    length = grammars.upwards(np.ones(grammars.terminals, np.int64), np.add)
    asking = _FIRST_WORD + len(_DEFINES)
    defines = grammars.upwards((grammars.word >= _FIRST_WORD) & (grammars.word < asking), np.logical_or)
    asks = grammars.upwards((grammars.word >= asking) & (grammars.word < asking + len(_ASKS)), np.logical_or)
    uses = grammars.uses()
    share = uses * length / counts[grammars.group]
    for x in np.flatnonzero((uses >= USES) & (length >= LENGTH) & (share >= min(COVER, COVER_COMPLEX)) & (defines | asks)).tolist():
        i = int(grammars.group[x])
        if reasons[i] is None and asks[x] and not defines[x]:
            conditions[i] = max(conditions[i], float(share[x]))
        elif reasons[i] is None:
            own = slice(*np.searchsorted(file, [i, i + 1]))
            if uses[x] >= COUNTED or _counts_up([words[k] for k in at[own]], kinds[own]):
                reasons[i] = "generated"
    return conditions


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), TOGETHER):
            part = b.iloc[a : a + TOGETHER]
            texts = [x or "" for x in part["content"]]
            python = [bool(p and p.lower().endswith(".py")) for p in part["file_path"]]
            found = features(texts, python)
            yield pd.DataFrame({
                "file_id": part["file_id"], "repo_id": part["repo_id"], "file_path": part["file_path"], "version": [xxhash.xxh64_intdigest(f"{p}{t}") - 2**63 for p, t in zip(python, texts)],
                "own_reason": [x[0] for x in found], "conditions": [x[1] for x in found], "statements": [x[2] for x in found], "pairs": [x[3] for x in found], "passages": [x[4] for x in found], "sizes": [x[5] for x in found],
            })


_SCHEMA = "file_id bigint, repo_id int, file_path string, version bigint, own_reason string, conditions double, statements int, pairs array<bigint>, passages array<bigint>, sizes array<int>"


def _ignored(files: DataFrame, scan_config: DataFrame) -> DataFrame:
    """Files below a folder, at any depth, that their repository ignores."""
    folders = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    return files.select("file_id", "repo_id", folders.alias("folders")).join(scan_config.select("repo_id", "ignored_dirs"), "repo_id").where(F.arrays_overlap("folders", "ignored_dirs")).select("file_id", F.lit("ignored folder").alias("reason"))


def _complex(own: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that conditions cover, if nearly all of them or if a symbol of theirs is as complex as hardly any hand writes."""
    worst = symbols.where(F.col("complexity") >= COMPLEX).select("repo_id", "file_path").distinct().withColumn("complex", F.lit(True))
    asked = own.where(F.col("conditions") > 0).select("file_id", "repo_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path"), "conditions")
    least = F.when(F.col("complex"), COVER_COMPLEX).otherwise(COVER_CONDITION)
    return asked.join(worst, ["repo_id", "file_path"], "left").where(F.col("conditions") >= least).select("file_id", F.lit("generated").alias("reason"))


def _copies(own: DataFrame, upstream: DataFrame) -> DataFrame:
    """Files of whose statements most lie in pairs that one third-party file holds too."""
    theirs = upstream.select(F.col("upstream_id").cast("bigint").alias("file_id"), F.lit(0).alias("repo_id"), "file_path", "content").mapInPandas(_features, _SCHEMA).select(F.col("file_id").alias("upstream_id"), F.explode("pairs").alias("rule")).distinct()
    rules = own.where(F.col("statements") >= LEAST_SHARED).select("file_id", "version", "statements", F.explode("pairs").alias("rule"))
    shared = rules.join(theirs, "rule").groupBy("file_id", "version", "upstream_id").agg(F.max("statements").alias("statements"), F.count("*").alias("n"))
    return shared.where((F.col("n") >= LEAST_SHARED) & (F.col("n") >= COPIED * (F.col("statements") - 1))).select("file_id", F.lit("third-party copy").alias("reason"))


def _spread_copies(own: DataFrame) -> DataFrame:
    """Files of whose statements most lie in passages that several repositories hold."""
    passages = own.where(F.col("statements") >= LEAST_SHARED).select("file_id", "version", F.coalesce("repo_id", F.lit(-1)).alias("repo_id"), "statements", F.explode(F.arrays_zip("passages", "sizes")).alias("p"))
    passages = passages.select("file_id", "version", "repo_id", "statements", F.col("p.passages").alias("rule"), F.col("p.sizes").alias("n"))
    held = passages.groupBy("rule", "repo_id").agg(F.count("*").alias("k")).groupBy("rule").agg(F.count("*").alias("repositories")).where(F.col("repositories") >= REPOSITORIES).select("rule")
    covered = passages.join(held, "rule").groupBy("file_id", "version").agg(F.max("statements").alias("statements"), F.sum("n").alias("n"))
    return covered.where((F.col("n") >= LEAST_SHARED) & (F.col("n") >= COPIED * F.col("statements"))).select("file_id", F.lit("shared across repositories").alias("reason"))


def not_hand_written(files: DataFrame, scan_config: DataFrame, upstream: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, reason), one row a file; of several reasons the first in the alphabet."""
    rows = spread(files.select("file_id", "repo_id", "file_path", "content"))
    # a repeated row would count its rules again; differing rows of one file_id are judged apart
    own = cut(rows.mapInPandas(_features, _SCHEMA).dropDuplicates(["file_id", "version"]))
    told = own.where("own_reason is not null").select("file_id", F.col("own_reason").alias("reason"))
    for more in (_complex(own, symbols), _copies(own, upstream), _spread_copies(own), _ignored(files, scan_config)):
        told = told.unionByName(more)
    return told.groupBy("file_id").agg(F.min("reason").alias("reason"))
