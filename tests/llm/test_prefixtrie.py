"""The trie against whole prefixes in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from firnline.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(seqs):
    members, out = defaultdict(list), {}
    for c, xs in seqs.items():
        for d in range(len(xs) + 1):
            members[tuple(xs[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def walk(k):
        below = [walk(x) for x in kids[k]]
        leaves = sum(b[0] for b in below) or 1
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return sorted(out.values(), key=repr)


def ordered(rows):
    seqs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            seqs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in seqs.items()}


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def made():
    rng, rows = random.Random(5), []
    for c in [*range(95, 130), 200, 205, 299, -3, -100]:
        n = rng.choice([0, 1, 2, 3, 6, 9])
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é" * 3, "", None])) for t in range(n)]
    rows += [(1, t, "user", f"w{t % 3}") for t in range(230)] + [(2, t, "user", f"w{t % 3}") for t in range(230)] + [(3, t, "user", f"w{t % 3}") for t in range(100)]
    rows += [(7, None, "z", "first"), (7, 0, "b", "tie"), (7, 0, "a", "tie"), (7, 0, "a", "tie"), (None, 0, "user", "nobody"), (300, 0, "user", "x" * 1_200_000)]
    rows += [(c, 0, "system", "same") for c in range(400, 400 + 2 * prefixtrie.PIECE + 5)]
    rng.shuffle(rows)
    return rows


def test_trie_as_it_stands(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA + ", digest string, pos int").repartition(5)
    assert got(prefixtrie.prefix_trie(df)) == slow(ordered(rows))


def test_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    rows = made()
    assert got(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == slow(ordered(rows))


def test_rebuilt(spark):
    rows = made()
    own = ordered(rows)
    built = {}
    for c, xs in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        built[c] = own.get(rest, [])[:h] + xs[h:]
    assert any(not xs for xs in built.values())
    assert got(prefixtrie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == slow(built)


def test_empty(spark):
    assert prefixtrie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0
