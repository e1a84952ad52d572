"""Encoding of a corpus by a byte-level BPE whose vocabulary is a public file, with chunks shared by documents encoded once.

Texts are cut where a rolling hash of the last WINDOW characters says so, so equal passages give equal chunks wherever
they stand. Of the chunks only hashes are shuffled; those that occur more than once are taken from the first document that
holds them, encoded once and joined back; what lies between them is encoded in place. Where two parts meet, the last piece
of the left one may be wrong, and so may an apostrophe before it (of 're, 've or 'll cut in two): pieces are cut anew from
its start in the whole text until a cut falls on one of the right part's first HEAD own, from where on the two agree, since
a piece depends only on the text from its start; if none does, the part is encoded in place. The result is that of the
whole text at once.

Defined results: null and empty texts give an empty list; special-token strings are ordinary text; repeated doc_ids give
a row each; texts of any length are encoded whole; an empty table gives no rows; other columns are ignored. A chunk that
only shares its hash with another is found out by turning its ids back into text, and encoded in place.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, skew_safe_lookup
from .syntax import spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, MASK, LEAST, HEAD = 16, 0xFF, 64, 8

_GEAR = np.random.default_rng(11).integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32)


@cache
def _encoding(folder: str):
    with open(os.path.join(folder, RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, folder: str):
        self.encoding, self.pattern = _encoding(folder), regex.compile(PATTERN)
        self.encode = self.encoding.encode_ordinary

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


def cuts(texts: list[str]) -> list[list[int]]:
    """Ends of the content-defined chunks of each text, at least LEAST characters apart, so no window reaches into another text."""
    sizes = [len(t) for t in texts]
    g = _GEAR[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) & 4095]
    h = np.zeros(len(g), dtype=np.uint32)
    for j in range(min(WINDOW, len(g))):
        h[j:] += g[: len(g) - j] << np.uint32(j)
    at = np.flatnonzero((h >> np.uint32(10)) & MASK == 0) + 1
    ends = np.cumsum(sizes)
    out = []
    for n, end, found in zip(sizes, ends.tolist(), np.split(at, np.searchsorted(at, ends, "right"))):
        own, last = [], 0
        for c in (found - (end - n)).tolist():
            if c - last >= LEAST and n - c >= LEAST:
                own.append(c)
                last = c
        out.append([*own, n] if n else own)
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [t or "" for t in b["text"]]
        found = cuts(texts)
        starts = [[0, *c[:-1]] if c else [] for c in found]
        hashes = [xxhash.xxh64_intdigest(t[a:e]) - 2**63 for t, s, c in zip(texts, starts, found) for a, e in zip(s, c)]
        begin = [a for s in starts for a in s]
        yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), [len(c) for c in found]), "start": begin, "size": [e - a for s, c in zip(starts, found) for a, e in zip(s, c)], "h": hashes})


def _unsure(pieces: list[str]) -> int:
    """How many of the last pieces before a cut may be others in the whole text, whatever follows the cut."""
    return min(len(pieces), 2 if len(pieces) > 1 and pieces[-2] == "'" else 1)


def part(text: str, encoder: Encoder) -> tuple[list[int], list[int], list[int], int, int]:
    """(ids, lengths and id counts of the first pieces, characters and ids of the last, unsure ones) of a chunk."""
    pieces, ids = encoder.pieces(text), encoder.encode(text)
    tail = pieces[len(pieces) - _unsure(pieces) :]
    return ids, [len(p) for p in pieces[:HEAD]], [len(encoder.encode(p)) for p in pieces[:HEAD]], sum(map(len, tail)), sum(len(encoder.encode(p)) for p in tail)


def assemble(text: str, parts: list[tuple], encoder: Encoder) -> list[int]:
    """ids of a text, of which parts (start, size, *part()) are known, in order of start."""
    out: list[int] = []
    pos = end = 0  # ids of text[:pos] are out; pos is a cut of the whole text; parts up to end are used
    for a, size, ids, lengths, counts, tail, tail_ids in parts:
        e = a + size
        if a < end or e > len(text) or encoder.encoding.decode_bytes(ids) != text[a:e].encode():
            continue
        end = e
        if pos < a:
            pieces = encoder.pieces(text[pos:a])
            pieces = pieces[: len(pieces) - _unsure(pieces)]
            if pieces:  # the last one apart: blanks before it would else take it in
                out += encoder.encode("".join(pieces[:-1])) + encoder.encode(pieces[-1])
                pos += sum(map(len, pieces))
        at, own = a, {}  # starts of the part's first pieces, with the ids before them
        before = 0
        for length, count in zip(lengths, counts):
            own[at] = before
            at, before = at + length, before + count
        while pos not in own and pos < at:
            m = encoder.pattern.match(text, pos)
            out += encoder.encode(m[0])
            pos = m.end()
        if pos in own:
            stop, last = (e, len(ids)) if e == len(text) else (e - tail, len(ids) - tail_ids)
            if stop > pos:
                out += ids[own[pos] : last]
                pos = stop
    return out + encoder.encode(text[pos:]) if pos < len(text) else out


_PART = "ids array<int>, lengths array<int>, counts array<int>, tail int, tail_ids int"


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of each row of documents."""
    docs = spread(documents.select("doc_id", "text"))
    chunks = cut(docs.mapInPandas(_chunks, "doc_id bigint, start int, size int, h bigint"))
    shared = chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "size")).alias("at")).where("n > 1").select("h", "at.*")
    held = documents.select("doc_id", "text").join(shared, "doc_id").select("h", F.substring("text", F.col("start") + 1, F.col("size")).alias("chunk"))

    def encode(batches):
        e = Encoder(folder)
        for b in batches:
            found = [(h, *part(c, e)) for h, c in zip(b["h"], b["chunk"]) if c and xxhash.xxh64_intdigest(c) - 2**63 == h]
            yield pd.DataFrame(found, columns=["h", "ids", "lengths", "counts", "tail", "tail_ids"])

    once = held.mapInPandas(encode, f"h bigint, {_PART}").dropDuplicates(["h"])
    placed = skew_safe_lookup(chunks, cut(once), ["h"])
    back = placed.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.sort_array(F.collect_list(F.struct("start", "size", "ids", "lengths", "counts", "tail", "tail_ids"))).alias("parts"))
    joined = docs.join(back, F.col("doc_id") == F.col("_doc_id"), "left").select("doc_id", "text", "parts")

    def put_together(batches):
        e = Encoder(folder)
        for b in batches:
            ids = []
            for text, parts in zip(b["text"], b["parts"]):
                if not text:
                    ids.append([])
                elif parts is None or not len(parts):
                    ids.append(e.encode(text))
                else:
                    ids.append(assemble(text, [(p["start"], p["size"], list(p["ids"]), list(p["lengths"]), list(p["counts"]), p["tail"], p["tail_ids"]) for p in parts], e))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids})

    return joined.mapInPandas(put_together, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """documents with n_tokens, the number of ids of text."""

    def count(batches):
        e = Encoder(folder)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [len(e.encode(t)) if t else 0 for t in b["text"]]})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")
