import random

import numpy as np

from strandline.llm import subjects as s

DOCS = "doc_id bigint, text string, lang string, terms int, leaf int"
WORDS = {k: [f"{k[:3]}{a}{b}o" for a in "bdfgklmn" for b in ("at", "el", "ir", "om", "un", "ak", "eb")] for k in ("music", "law", "energy", "other")}


def text(r, subject, n):
    return " ".join(f"The {r.choice(WORDS[subject])} of each {r.choice(WORDS[subject])} is kept next to its {r.choice(WORDS[subject])} today." for _ in range(n))


def test_held_out(spark):
    r = random.Random(1)
    docs, truth, labels = [], {}, []
    for i in range(600):
        kind = r.choice(["music", "law", "energy", "other", "both", "none", "aside"])
        if kind == "both":
            a, b = r.sample(["music", "law", "energy"], 2)
            truth[i] = {a, b}
            t = text(r, a, 4) + "\n" + text(r, b, 4)
        elif kind == "none":
            truth[i], t = set(), "The of each is kept next to its today. " * 3
        elif kind == "aside":
            truth[i], t = {"law"}, "My colleague compares this to a musbato with a muskelo, which is fun but off topic.\n" + text(r, "law", 4)
        else:
            truth[i] = {kind} - {"other"}
            t = text(r, kind, 5)
        docs.append((i, t, "en", 0, 0))
        if r.random() < 0.2:
            labels += [(i, x if r.random() > 0.05 else "music", "ann") for x in truth[i]]
    docs += [(9001, None, "en", 0, 0), (9002, "", None, 0, 0), (9003, "  \n", "de", 0, 0)]
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    lab = spark.createDataFrame(labels + [(5, "unknown", "x"), (77777, "law", "x"), (None, None, None)] + labels[:5], "doc_id bigint, subject string, labeller string")
    areas = spark.createDataFrame([("music", ""), ("law", ""), ("energy", ""), (None, "")], "subject string, about string")
    got = {}
    for x in s.assign(d, lab, areas).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = [i for i in truth if i not in {x[0] for x in labels}]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right / len(held) > 0.93
    assert not {9001, 9002, 9003} & set(got)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    lab = spark.createDataFrame([], "doc_id bigint, subject string, labeller string")
    areas = spark.createDataFrame([("law", "")], "subject string, about string")
    assert s.assign(empty, lab, areas).count() == 0
    one = spark.createDataFrame([(i, "verdict court jury", "en", 0, 0) for i in range(5)], DOCS)
    assert s.assign(one, lab, areas).count() == 0


def test_terms():
    assert s.terms("mergeOrderTable solar_flares, HTTPServer 42. Don't") == (["merge", "order", "table", "solar", "flare", "httpserver", "don"], [0] * 6 + [1])
    assert s.terms("The jury waits.\n\nIt waits") == (["the", "jury", "wait", "wait"], [0, 0, 0, 1])
    assert s.terms("月食观测。望远镜") == (["月食", "食观", "观测", "望远", "远镜"], [0, 0, 0, 1, 1])
    assert s.terms("a" * 60) == (["a" * 60], [0])
    assert s.terms(None) == ([], [])


def test_agreements():
    law, music, none = [0.9, 0.0, 0.1], [0.0, 0.8, 0.2], [0.3, 0.3, 0.4]
    p = np.array([law, none, law, law, music, music, none])
    assert s.agreements(p, np.array([0, 0, 1, 1, 2, 2, 3])) == [(0, True), (1, False), (2, False)]
    assert s.agreements(p[1:2], np.array([0])) == []


def test_asides_are_learned(spark):
    r = random.Random(2)
    docs = [(i, text(r, k := ("music", "law", "energy")[i % 3], 4) + f"\nBy the way a neighbour of mine would call that a {r.choice(WORDS[j := ('law', 'energy', 'music')[i % 3]])} with a {r.choice(WORDS[j])} and a {r.choice(WORDS[j])} for fun.", "en", 0, 0) for i in range(300)]
    labels = [(i, ("music", "law", "energy")[i % 3], "ann") for i in range(90)]
    got = s.assign(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string"), spark.createDataFrame([("music",), ("law",), ("energy",)], "subject string"))
    shares = {(x.doc_id, x.subject): x.share for x in got.collect()}
    assert {k for k in shares} == {(i, ("music", "law", "energy")[i % 3]) for i in range(300)} and min(shares.values()) > 0.9
