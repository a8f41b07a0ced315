"""FTRL, its features and the decoding of output codes against plain loops."""

import math
import random
import re

import numpy as np

from firnline.llm import langid, toxicity
from firnline.llm.textblocks import mixed, prefix_hashes, span_hashes

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def arrays(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def word_key(w):
    d = np.frombuffer(w, np.uint8)
    return span_hashes(prefix_hashes(d), np.array([0]), np.array([len(w)]))


def test_features_are_words_pairs_and_skip_pairs():
    texts = ["One two  three-FOUR", "", "one", "é two ÉE x y z " * 30]
    places, rows = toxicity.hashed_features(*arrays(texts))
    for i, t in enumerate(texts):
        keys = [word_key(w.lower()) for w in WORD.findall(t.encode())]
        pairs = lambda gap, salt: [mixed(a * np.uint64(salt) + b) for a, b in zip(keys, keys[gap:], strict=False)]  # noqa: E731, B023
        want = [int(k[0] >> np.uint64(64 - toxicity.BITS)) for k in [*keys, *pairs(1, 0xA24BAED4963EE407), *pairs(2, 0x9FB21C651E98DF25)]]
        assert sorted(places[rows == i].tolist()) == sorted(want)


def test_ftrl_by_hand():
    rng = random.Random(1)
    examples = [np.array(sorted(rng.sample(range(12), 4))) for _ in range(200)]
    labels = np.array([float(3 in e) for e in examples])
    z, n, bias, start = {}, {}, 1 << toxicity.BITS, -1.5

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for e, y in zip(examples, labels, strict=True):
            at = [*e.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(sum(w.values()) + start))) - y
            for i in at:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = toxicity.ftrl(examples, labels, epochs=3, start=start)
    assert np.allclose(got[[*range(12), bias]], [weight(i) for i in [*range(12), bias]])
    assert not got[12:bias].any() and got[3] > 0


def test_decoding_by_loops():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 9):
        code = langid.codewords(n)
        model = langid.Model(tuple(f"l{i}" for i in range(n)), code, np.zeros((4, code.shape[1])), rng.random(code.shape[1]) + 0.1)
        margins = rng.normal(size=(40, code.shape[1])) * 2
        best, score, unsure = langid.decode(margins, model)
        for i, m in enumerate(margins):
            loss = [sum(model.strength[b] * math.log1p(math.exp(-m[b] * code[k, b])) for b in range(len(m))) / model.strength.sum() for k in range(n)]
            likely = [math.exp(2 * (min(loss) - x)) for x in loss]
            shares = sorted((x / sum(likely) for x in likely), reverse=True)
            assert best[i] == loss.index(min(loss)) and math.isclose(score[i], shares[0])
            assert unsure[i] == (n > 1 and shares[0] - shares[1] < langid.AMBIGUOUS)


def test_few_labels_mark_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good words here", "bad words", None, ""])], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.0] * 4
    assert toxicity.reject_toxic(docs, none).count() == 4
    two = spark.createDataFrame([(0, 0), (3, 0), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert toxicity.reject_toxic(docs, two).count() == 4
    assert {r.predicted for r in toxicity.score_documents(docs, two).collect()} == {0}


def test_texts_without_ngrams(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["", "a", None, "!", "b", "some words"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_documents(docs.where("doc_id < 5")).collect()}
    assert len(got) == 5 and all(r.lang_pred in ("und", "en") and 0 <= r.score <= 1 for r in got.values())
    assert got[0].lang_pred == got[2].lang_pred == got[3].lang_pred == "und"


def test_a_text_over_a_block(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(0, None, "a"), (1, long, "a"), (2, "", "b"), (3, "kurz und gut " * 50, "b"), (4, "short and good " * 50, "a"), (5, long[:900_000], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(6)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs.join(labels, "doc_id"))).collect()}
    assert scores[0] == scores[2] and len(scores) == 6
    assert {r.doc_id for r in langid.identify_documents(docs).collect() if r.lang_pred == "und"} == {0, 2}
