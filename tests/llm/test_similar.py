"""The pipeline's near-duplicate stage against a brute-force join of shingle sets."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from firnline.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def components(texts):
    """The root (least index) of each text, and the number of pairs of different sets that are similar."""
    sets, parent, linked = [shingle_set(t) for t in texts], list(range(len(texts))), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s == t or 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 5 * (both := len(s & t)) >= 4 * (len(s) + len(t) - both):
                linked += s != t
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], linked


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small", [16, 2])
def test_edited_copies_go(spark, monkeypatch, small):
    monkeypatch.setattr(similar, "SMALL_BAND", small)
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One", "two words", "two  words"]
    for _ in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [edited(base, rng, rng.randint(0, 6)) for _ in range(12)]
    rng.shuffle(texts)
    want, linked = components(texts)
    assert linked > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == Counter(set(want))


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, linked = components([t for _, t in rows])
    assert linked > 0
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == Counter(rows[i][0] for i in set(want))
