"""Hashes modulo a prime: as in plain Python, and texts written to collide modulo a power of two."""

import hashlib
import random

import numpy as np

from firnline.llm import linededup, quality
from firnline.llm import textblocks as tb


def doubled(n, a, b):
    """Two sequences of n letters that agree under every polynomial hash modulo 2**64 once they are long enough."""
    x, y = [a], [b]
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_products_and_spans():
    rng = random.Random(3)
    x = [rng.randrange(tb.PRIME) for _ in range(500)] + [0, 1, tb.PRIME - 1, tb.PRIME - 2]
    y = x[::-1]
    assert tb.times(np.array(x, np.uint64), np.array(y, np.uint64)).tolist() == [a * b % tb.PRIME for a, b in zip(x, y, strict=True)]
    for base in (tb.random_base(), (1 << 60) + 7, tb.PRIME - 1):
        values = np.array([rng.randrange(1, tb.PRIME) for _ in range(300)], np.uint64)
        prefix = tb.keyed_prefix(values, base)
        spans = [sorted(rng.sample(range(301), 2)) for _ in range(100)]
        got = tb.keyed_spans(prefix, np.array([s for s, _ in spans]), np.array([e for _, e in spans]), base)
        assert got.tolist() == [sum(int(v) * pow(base, i, tb.PRIME) for i, v in enumerate(values[s:e])) % tb.PRIME for s, e in spans]


def test_long_texts():
    data = np.frombuffer(("ab\n" * 1_000_000).encode(), np.uint8)
    assert len(data) > tb.BLOCK_BYTES
    base = tb.random_base()
    prefix = tb.keyed_prefix(tb.LETTERS[data], base)
    at = np.array([0, 3, 1_500_000, 2_999_997])
    assert len(set(tb.keyed_spans(prefix, at, at + 3, base).tolist())) == 1


def lines(n):
    return ["".join(x) for x in doubled(n, "a", "b")]


def test_crafted_lines_are_told_apart(spark):
    for n in (1024, 2048):
        x, y = lines(n)
        assert x != y
        docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}")], "doc_id long, text string")
        assert {r.doc_id: r.n_dup_lines for r in quality.judge(docs).collect()} == {1: 0, 2: 1}
        words = [" ".join(w) for w in doubled(n, "alpha", "beta")]
        docs = spark.createDataFrame([(1, x), (2, y), (3, words[0]), (4, words[1]), (5, y)], "doc_id long, text string")
        got = {r.doc_id: (r.n_removed, r.text) for r in linededup.line_report(docs).collect()}
        assert [got[i][0] for i in (1, 2, 3, 4)] == [0, 0, 0, 0] and got[5] == (n, "")


def test_runs_of_a_query_agree(spark):
    """Bases differ from run to run, results do not."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [sorted((r.doc_id, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256) for r in linededup.line_report(docs).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and all(r[2] for r in rows[0]) and any(r[1] for r in rows[0])
