import random
import string

import pytest

from strandline.llm import encoding as e

DOCS = "doc_id bigint, text string, ids string, h int"


def whole(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{e.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_against_the_whole_text(spark):
    r = random.Random(3)
    shared = ["".join(r.choice(string.ascii_letters + "  \n\t.,'é世🙂0123456789") for _ in range(r.randrange(20, 400))) for _ in range(6)]
    texts = [None, "", " ", "a", "<|endoftext|> it's  \n\n  x", "x" * 5000, " " * 3000 + "y", "don't " * 900]
    for i in range(60):
        texts.append("".join(r.choice(shared) if r.random() < 0.7 else "".join(r.choice(string.printable) for _ in range(r.randrange(80))) for _ in range(r.randrange(1, 8))))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    got = {r.doc_id: r.ids for r in e.encode_corpus(df).collect()}
    assert got == dict(enumerate(whole([t or "" for t in texts])))
    assert e.encode_corpus(df.where("false")).count() == 0


def test_any_cut_is_repaired():
    r = random.Random(4)
    enc = e.Encoder(e.TOKENIZERS)
    for _ in range(300):
        text = "".join(r.choice("ab  \n'st9é.") for _ in range(r.randrange(1, 60)))
        cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(5))})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            if r.random() < 0.7:
                parts.append((a, b - a, *e.part(text[a:b], enc)))
        assert e.assemble(text, parts, enc) == enc.encode(text)


def test_every_cut_of_contractions_is_repaired():
    enc = e.Encoder(e.TOKENIZERS)
    texts = [f"{a}'{c}{z}" for a in ("they", "a ", "", "x'", "1", "é\n") for c in ("s", "t", "re", "ve", "m", "ll", "d", "RE", "r", "l") for z in ("", "n", " we'll", "'ve 'll")]

    for text in texts:
        n = len(text)
        for i in range(n + 1):
            for j in range(i, n + 1):
                spans = [(a, b) for a, b in ((0, i), (i, j), (j, n)) if a < b]
                for known in range(2 ** len(spans)):
                    parts = [(a, b - a, *e.part(text[a:b], enc)) for k, (a, b) in enumerate(spans) if known >> k & 1]
                    assert e.assemble(text, parts, enc) == enc.encode(text), (text, parts)


def test_a_chunk_of_another_text_is_not_used():
    enc = e.Encoder(e.TOKENIZERS)
    assert e.assemble("hello world", [(0, 5, *e.part("other", enc))], enc) == enc.encode("hello world")
    assert e.assemble("hello", [(0, 9, *e.part("hello you", enc)), (0, 5, *e.part("hello", enc))], enc) == enc.encode("hello")


def contractions(r, n):
    words = "they we you it he don can I the store reads all rows of a table ' '' 's".split()
    return "".join(r.choice(words) + r.choice(["'ll", "'ve", "'re", "'s", "'t", "'d", "'m", "", "", "'", "'l", "'LL"]) + r.choice([" ", " ", "  ", "\n", ", ", "", "\n\n  "]) for _ in range(n))


def test_texts_full_of_contractions():
    r, enc = random.Random(6), e.Encoder(e.TOKENIZERS)
    texts = [contractions(r, r.randrange(1, 160)) for _ in range(1500)]
    for text, ends in zip(texts, e.cuts(texts)):
        ends = sorted({*ends, *(r.randrange(1, len(text)) for _ in range(3 if len(text) > 1 else 0))})
        parts = [(a, b - a, *e.part(text[a:b], enc)) for a, b in zip([0, *ends], ends) if r.random() < 0.6]
        assert e.assemble(text, parts, enc) == enc.encode(text)


def test_repeated_ids_and_hot_chunks(spark):
    r = random.Random(7)
    hot = contractions(r, 300)
    texts = [hot + contractions(r, 20) for _ in range(40)] + [hot] * 5
    df = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    enc = e.Encoder(e.TOKENIZERS)
    assert sorted((x.doc_id, x.ids) for x in e.encode_corpus(df).collect()) == sorted((i // 2, enc.encode(t)) for i, t in enumerate(texts))


def test_chunks_do_not_depend_on_their_place():
    r = random.Random(5)
    passage = "".join(r.choice(string.ascii_lowercase + " ") for _ in range(2000))

    def chunks(text):
        ends = e.cuts(["before", text, "after"])[1]
        return {text[a:b] for a, b in zip([0, *ends], ends)}

    assert len(chunks("something else " * 20 + passage) & chunks(passage)) > 3
    assert e.cuts(["", "abc", "x" * 70, ""]) == [[], [3], [70], []] and e.cuts([]) == [] and e.cuts([""]) == [[]]
    for n in (1, 63, 64, 128, 129, 5000):
        text = passage[:n]
        ends = e.cuts([text])[0]
        assert ends[-1] == len(text) and all(b - a >= e.LEAST for a, b in zip([0, *ends], ends)) or len(text) < e.LEAST
