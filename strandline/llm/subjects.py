"""Subject areas of documents: bisecting k-means, leaves labelled by discriminative terms, mixtures of leaves.

Words that are common in some language say nothing about the subject and leave the vocabulary; so do rare ones. The
normalised tf-idf vectors of all documents are clustered by bisecting k-means. A leaf's discriminative terms are those
that its documents use far more often than all do; a leaf gets the subject that hand-labelled documents with these terms
mostly have, or none. A term thus belongs to subjects in the shares in which the documents that use it lie in their leaves.
A document's mixture is that of its terms, sharpened by the document's own mixture until it settles, so that a term of two
subjects goes with its company; subjects above SHARE are assigned. Comparisons and mentions are learned: the words of a
sentence that belong to no one subject are its frame, and a frame whose sentences mostly speak of another subject than the
rest of their documents is an aside, whose terms count nowhere.

Bounds: a vocabulary term lies in at least MIN_SHARE of all documents, so there are at most (mean number of distinct terms
a document) / MIN_SHARE terms, and never more than VOCABULARY, for which the least number of documents is raised; only
the vocabulary, each of its terms' shares of the subjects, the leaves' subjects and at most ASIDES frames reach the driver
or a broadcast. All
statistics are over all documents; of labelled rows at most LABELS are used, the first by document and subject.

Defined results: null, empty and blank texts, texts without vocabulary terms and documents whose terms belong to no listed
subject give no row; text without blanks (Chinese, Japanese, Thai) counts by pairs of neighbouring characters; repeated
documents and labels count as they lie but give one row; labels of unknown subjects or documents are ignored; without
labels nothing is assigned; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import cut, drop_cut
from .syntax import spread

LABELS = 200_000
MIN_SHARE, LEAST_DOCUMENTS, COMMON_SHARE, LANGUAGE_SIZE, VOCABULARY = 0.0002, 3, 0.12, 50, 30_000
LEAVES, LEAF_SIZE, ITERATIONS, SEED = 512, 20, 4, 7
#: A leaf's terms are the TERMS most discriminative; its subject must hold LEAF_SHARE of their evidence, which
#: must reach LEAF_COVERED of their weight.
TERMS, LEAF_SHARE, LEAF_COVERED = 25, 0.5, 0.3
#: A document's subject needs SHARE of the mixture and EVIDENCE terms.
SHARE, EVIDENCE = 0.27, 1.5
#: A frame of at least FRAME words in at least FRAME_USES sentences is an aside if less than AGREEING of them agree with the rest.
FRAME, FRAME_USES, AGREEING, ASIDES = 3, 10, 0.35, 100_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|(?<=[\u3002\uff01\uff1f])")
_WORD = re.compile(r"[^\W\d_a-z]?[^\W\d_A-Z]+|[^\W\d_]+")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def terms(text: str | None) -> tuple[list[str], list[int]]:
    """Words of a text in lower case without plural s, names in code split up, and the number of the sentence of each."""
    out: list[str] = []
    at: list[int] = []
    for n, s in enumerate(_SENTENCE.split(unicodedata.normalize("NFC", text or ""))):
        before = len(out)
        for w in _WORD.findall(s):
            if _UNSPACED.search(w):
                out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
            elif len(w) > 2:
                w = w.lower()
                out.append(w[:-1] if w[-1] == "s" and w[-2] != "s" and len(w) > 3 else w)
        at += [n] * (len(out) - before)
    return out, at


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [terms(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "terms": [t for t, _ in found], "at": [a for _, a in found]})


def vocabulary(docs: DataFrame, total: int) -> list[str]:
    """Terms neither rare nor common in any language; see the module's first lines for the bound."""
    by_lang = docs.select(F.coalesce("lang", F.lit("?")).alias("lang"), F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang", "term").count()
    sizes = docs.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("size"))
    common = (F.col("count") > COMMON_SHARE * F.col("size")) & (F.col("size") >= LANGUAGE_SIZE)
    kept = by_lang.join(sizes, "lang").groupBy("term").agg(F.sum("count").alias("df"), F.bool_or(common).alias("common"))
    least = max(LEAST_DOCUMENTS, math.ceil(MIN_SHARE * total))
    return sorted(r[0] for r in kept.where(~F.col("common") & (F.col("df") >= least)).orderBy(F.desc("df"), "term").limit(VOCABULARY).select("term").collect())


def _leaves(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, terms, at, leaf) of documents with vocabulary terms."""
    model = CountVectorizerModel.from_vocabulary(words, inputCol="terms", outputCol="tf")
    counted = model.transform(docs)
    empty = model.transform(docs.sparkSession.createDataFrame([(None, [], [])], docs.schema))  # so that no term lies in all documents, which would weigh nothing
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted.unionByName(empty)).transform(counted)
    vectors = Normalizer(inputCol="tfidf", outputCol="features").transform(weighted).select("doc_id", "terms", "at", "features")
    vectors = cut(vectors)
    used = vectors.select("doc_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    model = BisectingKMeans(k=LEAVES, maxIter=ITERATIONS, minDivisibleClusterSize=LEAF_SIZE, seed=SEED, distanceMeasure="cosine", predictionCol="leaf").fit(used)
    out = cut(model.transform(vectors).select("doc_id", "terms", "at", "leaf"))
    used.unpersist()
    drop_cut(vectors)
    return out


def _named(by_leaf: DataFrame, evidence: DataFrame) -> DataFrame:
    """(leaf, subject) of each leaf that has one. by_leaf: term, leaf, n; evidence: term, subject, n."""
    of = lambda *c: Window.partitionBy(*c)
    sums = by_leaf.withColumns({"term_n": F.sum("n").over(of("term"))}).join(by_leaf.groupBy("leaf").agg(F.sum("n").alias("leaf_n")), "leaf")
    lift = F.col("n") / F.col("term_n") / (F.col("leaf_n") / by_leaf.agg(F.sum("n")).scalar())
    weighed = sums.withColumn("lift", lift).where("lift > 1.5").withColumn("weight", F.col("n") * F.log("lift"))
    top = weighed.withColumn("place", F.row_number().over(of("leaf").orderBy(F.desc("weight"), "term"))).where(F.col("place") <= TERMS).withColumn("whole", F.sum("weight").over(of("leaf")))
    rates = evidence.withColumn("rate", F.col("n") / F.sum("n").over(of("subject"))).withColumn("share", F.col("rate") / F.sum("rate").over(of("term")))
    score = top.join(rates.select("term", "subject", "share"), "term").groupBy("leaf", "subject").agg(F.sum(F.col("weight") * F.col("share")).alias("s"), F.max("whole").alias("whole"))
    best = score.groupBy("leaf").agg(F.max_by(F.struct("subject", "s"), F.struct("s", "subject")).alias("b"), F.sum("s").alias("covered"), F.max("whole").alias("whole"))
    return best.where((F.col("b.s") >= LEAF_SHARE * F.col("covered")) & (F.col("covered") >= LEAF_COVERED * F.col("whole"))).select("leaf", "b.subject")


def _shares(by_leaf: DataFrame, named: DataFrame, subjects: list[str]) -> DataFrame:
    """(term, shares): of each term, the shares of the subjects, the last being all that has no subject."""
    known = by_leaf.join(F.broadcast(named), "leaf", "left")  # a row a leaf
    parts = [F.sum(F.when(F.col("subject") == s, F.col("n")).otherwise(0)) / F.sum("n") for s in subjects]
    return known.groupBy("term").agg(F.array(*parts, F.sum(F.when(F.col("subject").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("shares"))


def mixture(p: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The settled mixture of terms with the given shares, a row a term."""
    mix = p.mean(axis=0)
    for _ in range(rounds):
        r = p * mix
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-12)
        mix = r.mean(axis=0)
    return mix


def agreements(p: np.ndarray, at: np.ndarray) -> list[tuple[int, bool]]:
    """Of each sentence that speaks of one subject, whether most of what the other sentences say of subjects is of it."""
    sure = p[:, :-1].max(axis=1) >= 0.5
    p, at = p[sure, :-1], at[sure]
    if not len(p):
        return []
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sums = np.add.reduceat(p, starts)
    rest = sums.sum(axis=0) - sums
    own = sums.argmax(axis=1)
    speaks = (sums.max(axis=1) >= 0.5 * np.diff(np.append(starts, len(at)))) & (rest.max(axis=1) >= 1)
    return [(int(at[starts[i]]), bool(own[i] == rest[i].argmax())) for i in np.flatnonzero(speaks)]


class Shares:
    """Shares of the subjects by term, and which terms belong to one subject."""

    def __init__(self, rows: list[tuple[str, list[float]]]):
        self.of = {term: i for i, (term, _) in enumerate(rows)}
        self.rows = np.array([v for _, v in rows]) if rows else np.zeros((0, 1))
        self.sure = frozenset(term for term, v in rows if max(v[:-1], default=0) >= 0.5)

    def known(self, terms: list[str], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Shares and sentences of the known ones of a document's terms."""
        found = [(i, a) for i, a in zip(map(self.of.get, terms), at) if i is not None]
        return self.rows[[i for i, _ in found]], np.array([a for _, a in found], dtype=np.int64)

    def frames(self, terms: list[str], at: list[int]) -> dict[int, int]:
        """The frames of a document's sentences of enough words."""
        words: dict[int, list[str]] = {}
        for w, a in zip(terms, at):
            if w not in self.sure:
                words.setdefault(a, []).append(w)
        return {a: xxhash.xxh64_intdigest(" ".join(f)) - 2**63 for a, f in words.items() if len(f) >= FRAME}


def _asides(leaves: DataFrame, shares) -> list[int]:
    """The frames whose sentences mostly disagree with the rest of their documents."""

    def agree(batches):
        for b in batches:
            rows = []
            for terms, at in zip(b["terms"], b["at"]):
                terms, at = terms.tolist(), at.tolist()
                votes = agreements(*shares.value.known(terms, at))
                if votes:
                    frames = shares.value.frames(terms, at)
                    rows += [(frames[a], ok) for a, ok in votes if a in frames]
            yield pd.DataFrame(rows, columns=["frame", "agrees"])

    votes = leaves.select("terms", "at").mapInPandas(agree, "frame bigint, agrees boolean").groupBy("frame").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"))
    return [r[0] for r in votes.where((F.col("n") >= FRAME_USES) & (F.col("agreeing") < AGREEING * F.col("n"))).orderBy(F.desc("n"), "frame").limit(ASIDES).select("frame").collect()]


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of all documents."""
    spark = documents.sparkSession
    schema = "doc_id bigint, lang string, terms array<string>, at array<int>"
    docs = cut(spread(documents.select("doc_id", "lang", "text")).mapInPandas(_terms, schema))
    total = docs.count()
    words = vocabulary(docs, total) if total else []
    subjects = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())  # a fixed table
    empty = spark.createDataFrame([], "doc_id bigint, subject string, share double")
    if len(words) < 2 or not subjects:
        return empty
    known = spark.sparkContext.broadcast(frozenset(words))

    def speaking(batches):
        for b in batches:
            yield b[[not known.value.isdisjoint(t) for t in b["terms"]]]

    leaves = _leaves(docs.mapInPandas(speaking, schema).drop("lang"), words)
    vocabulary_ = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))  # at most VOCABULARY rows
    uses = leaves.select("doc_id", "leaf", F.explode(F.array_distinct("terms")).alias("term")).join(vocabulary_, "term", "left_semi")
    by_leaf = cut(uses.groupBy("term", "leaf").agg(F.count("*").alias("n")))
    given = labels.select("doc_id", "subject").where(F.col("subject").isin(subjects)).distinct().orderBy("doc_id", "subject").limit(LABELS)
    given = given.join(given.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id")
    evidence = uses.join(given, "doc_id").groupBy("term", "subject").agg(F.sum(1 / F.col("k")).alias("n"))
    found = _shares(by_leaf, _named(by_leaf, evidence), subjects).collect()  # a row a vocabulary term
    shares = spark.sparkContext.broadcast(Shares([(r["term"], r["shares"]) for r in found]))
    asides = spark.sparkContext.broadcast(frozenset(_asides(leaves, shares)))

    def decide(batches):
        for b in batches:
            rows = []
            for doc_id, terms, at in zip(b["doc_id"], b["terms"], b["at"]):
                terms, at = terms.tolist(), at.tolist()
                p, places = shares.value.known(terms, at)
                if asides.value and len(p):
                    aside = [a for a, f in shares.value.frames(terms, at).items() if f in asides.value]
                    p = p[~np.isin(places, aside)] if aside else p
                if len(p):
                    rows += [(doc_id, s, float(x)) for s, x in zip(subjects, mixture(p)) if x >= SHARE and x * len(p) >= EVIDENCE]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    return leaves.select("doc_id", "terms", "at").mapInPandas(decide, "doc_id bigint, subject string, share double")
