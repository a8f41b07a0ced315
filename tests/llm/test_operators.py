"""Operators against brute force, on small tables with nulls, empties, ties, repeats, long texts and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from firnline.llm import decontamination, langid, linededup, mixing, quality, sharding, simhash, suffix, tokenbin, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, content string, _d string, fp long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(rng.choice("aeioust nrlé".replace(" ", "")) for _ in range(rng.randint(2, 8))) if vocabulary == 0 else f"w{rng.randrange(vocabulary):x}é"
        out.append(w + ("." if i % 9 == 8 else "") + ("\n" if i % 31 == 30 else ""))
    return " ".join(out)


PASSAGE = prose(99, 70, 0)


def texts() -> list:
    base = prose(1, 300, 0)
    edited = base.split(" ")
    edited[150] = "changed"
    half = base[: len(base) // 2]
    return [
        base, base, " ".join(edited), None, "", "   \n\t", "one", "Two WORDS", prose(2, 60, 0) + "\n" + PASSAGE + "\n" + prose(3, 60, 0), PASSAGE, prose(4, 80, 0) + " " + PASSAGE,
        "ab " * 400, "a" * 5000, "línea repetida aquí con varias palabras más\n" * 30, prose(5, 20000, 0), half, "é" * 250 + half, "!!! ??? 123", "\n".join(["x y z w v u t s"] * 3), prose(6, 100, 0).upper(),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, 0.5, "c", "d", 7) for i, t in enumerate(texts())]
    rows += [rows[0], rows[8], (None, "no id here", None, None, 3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def bag(items) -> Counter:
    return Counter(map(tuple, items))


# sharding ---------------------------------------------------------------------------------------------------------


def test_shards_of_all_rows(docs, rows):
    got = sharding.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_follow_weights_and_move_only_where_they_change(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    tree = sharding.balanced(8, weights=[1, 1, 1, 1, 2, 2, 1, 1])
    count = {r.shard: r["count"] for r in sharding.assign_shards(keys, "k", tree).groupBy("shard").count().collect()}
    assert abs(count[4] / count[0] - 2) < 0.15
    moved = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), tree.grown()).alias("b"), sharding.shard_of(F.col("k"), tree.grown().grown()).alias("c"), sharding.shard_of(F.col("k"), tree.reweighted({0: 2})).alias("d"))
    assert moved.where("a <> b and b <> 8").count() == 0 and moved.where("b <> c and c <> 9").count() == 0 and moved.where("b = 8").count() > 2000
    # shard 0 is in region 0 (shards 0 to 3) and rack 0 (shards 0 and 1): keys only go further into the changed subtrees
    assert moved.where("a <> d and not (a > 3 and d < 4) and not (a in (2, 3) and d < 2) and not (a = 1 and d = 0)").count() == 0


def test_slots_of_one_key_that_holds_a_third(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit(0).alias("shard"))
    assert sorted(r.slot for r in sharding.slotted(rows, "shard", blocks=5).collect()) == list(range(3000))


# toxicity ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    bad = ["idiot", "moron", "scum"]
    rows = []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        words = prose(1000 + i, rng.randint(20, 120)).split(" ")
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    got = toxicity.score_documents(labelled, labelled.select("doc_id", "toxic")).join(labelled.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) > 0.95
    assert sum(s >= 0.3 for s in neg) / len(neg) < 0.05


def test_toxicity_scores_every_row(docs, empty, labelled, rows):
    got = toxicity.score_documents(docs, labelled.select("doc_id", "toxic")).collect()
    assert bag((r.doc_id,) for r in got) == bag((d,) for d, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty, labelled.select("doc_id", "toxic").limit(0)).count() == 0
    kept = toxicity.reject_toxic(docs, labelled.select("doc_id", "toxic"))
    assert kept.columns == docs.columns


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    examples = [np.unique(np.append(rng.integers(10, 5000, 50), 3 if i % 4 == 0 else 4)).astype(np.int32) for i in range(400)]
    w = toxicity.ftrl(examples, np.array([float(i % 4 == 0) for i in range(400)]))
    assert w[3] > 0.5 and (w != 0).sum() < 400


# decontamination --------------------------------------------------------------------------------------------------


def hits(text, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, named = words(text), set(), set()
    for name, t in items:
        v = words(t)
        for s in range(max(1, len(v) - span + 1) if v else 0):
            win = v[s : s + span]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    named.add("" if name is None else str(name))
    ids = ",".join(sorted(named))
    return len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items():
    return [(1, " ".join(PASSAGE.split()[5:30])), (2, " ".join(PASSAGE.split()[20:32])), (10, "two words"), (3, None), (4, "!!"), (5, "ab ab ab"), (None, "123"), (1, "Two, WORDS")]


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_WINDOWS, 0])
def test_contamination(spark, docs, rows, items, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, words string")
    got = decontamination.mark_contamination(docs, bench).collect()
    assert bag(got) == bag((d, *hits(t, items)) for d, t in rows)
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and bag((r.doc_id, r.text) for r in clean.collect()) == bag((d, t) for d, t in rows if not hits(t, items)[-1])


def test_contamination_of_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.mark_contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.mark_contamination(empty, none).count() == 0


# token files ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_files(docs, rows, tokenizer_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    got = sorted(tokenbin.tokenize_documents(docs, tokenizer_path, partitions=4).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids, strict=True))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_token_files_of_nothing(empty, tokenizer_path):
    assert tokenbin.tokenize_documents(empty, tokenizer_path, partitions=2).count() == 0


def test_frames_are_read_alone_and_checked(tmp_path):
    docs = [(None, b"\1\0\0\0"), (3, b""), *[(k, np.arange(k, dtype="<u4").tobytes()) for k in range(5, 90)]]
    with open(tmp_path / "f", "wb") as out:
        w = tokenbin.Writer(out, frame_bytes=512)
        for d in docs:
            w.add(*d)
        w.close()
    size = (tmp_path / "f").stat().st_size
    with open(tmp_path / "f", "rb") as source:
        r = tokenbin.Reader(source, size)
        assert list(r.documents()) == docs and len(r.frames) > 5
        assert all(r.document(i) == d[1] for i, d in enumerate(docs))
    data = bytearray((tmp_path / "f").read_bytes())
    data[int(r.places[2]) + 9] ^= 1
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as source:
        r = tokenbin.Reader(source, size)
        assert r.document(0) == docs[0][1]  # other frames are whole
        with pytest.raises((ValueError, tokenbin.zstandard.ZstdError)):
            r.frame(2)
    data[-30] ^= 1
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as source, pytest.raises(ValueError):
        tokenbin.Reader(source, size)


# simhash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps: dict, bits=2) -> dict:
    keys, parent = list(fps), {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, rows, empty):
    got = simhash.simhash_report(docs).collect()
    fps = {d: slow_fingerprint(t) for d, t in rows if d is not None}
    want = roots(fps)
    assert bag(got) == bag((d, f"{slow_fingerprint(t):016x}", want[d] if d is not None else None) for d, t in rows)
    assert simhash.simhash_report(empty).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and bag((r.doc_id,) for r in kept.collect()) == bag((x,) for x in {*want.values(), None})


@pytest.mark.parametrize("small", [6, 1])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_SET", small)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 7, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges)
    want = roots({signed(x): x for x in fps})
    parent = {signed(x): signed(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        a, b = find(r.a), find(r.b)
        parent[max(a, b)] = min(a, b)
    assert Counter(Counter(find(x) for x in parent).values()) == Counter(Counter(want.values()).values())


# languages --------------------------------------------------------------------------------------------------------


def test_languages(spark):
    words = {"aa": ["baba", "bubu", "bobe", "abu"], "bb": ["kitki", "tikt", "ikti"], "cc": ["zoroz", "oroz", "zzor"], "dd": ["mnelé", "élnem", "lené"]}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(400))]
    rows += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (903, "Baba BUBU", None), (903, "Baba BUBU", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows[:400] if got[i].held_out)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.identify_documents(df).count() == len(rows)
    assert langid.identify_documents(df.limit(0)).count() == 0
    unlabelled = langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 4, 6, 30):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


# quality ----------------------------------------------------------------------------------------------------------


def slow_quality(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    c, mark = Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if c[g] > 1:
            mark[i : i + 3] = [True] * 3
    n, r = len(w), sum(mark)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, r, n < 50 or 100 * r > 50 * n


def slow_share(text):
    w = WORD.findall(text or "")
    chars, best = max(1, sum(map(len, w))), 0.0
    for n, limit in quality.NGRAM_LIMITS.items():
        seen, mark = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                mark.update(range(i, i + n))
            seen.add(g)
        best = max(best, sum(len(w[i]) for i in mark) / chars / limit)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        v = WORD.findall(line)
        if v and line in seen:
            dup += sum(map(len, v))
        seen.add(line)
    return max(best, dup / chars / quality.LINE_LIMIT)


def test_quality(docs, rows, empty):
    got = quality.judge(docs).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag((d, *slow_quality(t)) for d, t in rows)
    share = {d: slow_share(t) for d, t in rows}
    for r in got:
        assert math.isclose(r.top_share, share[r.doc_id], rel_tol=1e-9, abs_tol=1e-12)
        assert r.kept == (not r.base_failed and r.top_share <= 1)
    assert quality.judge(empty).count() == 0


# mixing -----------------------------------------------------------------------------------------------------------


def test_mixing_reads_sources_by_weight(spark, docs, empty):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else None) for i in range(900)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, source string")
    got = mixing.mixture(df, entropy=0.95, repetition=3.0).collect()
    tokens = lambda t: len(t.split()) + 1
    total, read = Counter(), Counter()
    for _, t, s in [*rows, rows[0], rows[0]]:
        total[s or ""] += tokens(t)
    for r in got:
        read[r.source] += r.n_tokens
    ratio = {s: read[s] / total[s] for s in total}
    assert math.isclose(ratio["big"], 1.0) and 1 < ratio["mid"] <= 3.02 and 1 < ratio[""] <= 3.02
    share = [read[s] / sum(read.values()) for s in read]
    assert -sum(p * math.log(p) for p in share) >= 0.94 * math.log(3) or max(ratio.values()) > 2.9
    for s in total:  # a pass is a permutation without gaps
        spans = sorted((r.start, r.n_tokens) for r in got if r.source == s and r["pass"] == 0)
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    assert bag((r.doc_id,) for r in got if r["pass"] == 0) == bag((x[0],) for x in [*rows, rows[0], rows[0]])
    assert mixing.mixture(empty).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_mixing_keeps_to_a_budget(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mixture(df, budget=120).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.n for r in got} == {60}


# line dedup -------------------------------------------------------------------------------------------------------


def slow_units(rows):
    """Removed spans of each (doc_id, text)."""
    spans, seen = defaultdict(list), {}
    found = []
    for d, t in {(d, t) for d, t in rows}:
        at = 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", t or ""):
            cut = [m.end() for m in re.finditer(r"[.!?] ", line)]
            edges = [0, *cut, len(line)]
            units = [(0, len(line), linededup.LINE_WORDS)] + ([(a, b, linededup.SENTENCE_WORDS) for a, b in zip(edges, edges[1:], strict=False) if b > a] if cut else [])
            for a, b, least in units:
                w = tuple(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line[a:b])))
                if len(w) >= least:
                    bytes_at = lambda k, at=at, line=line: len((t[:at] + line[:k]).encode())
                    found.append((w, ((d is not None, d or 0), t, bytes_at(a)), bytes_at(b)))
            at += len(line)
    return found, spans, seen


def test_line_dedup(docs, rows, empty):
    got = linededup.line_report(docs).collect()
    assert bag((r.doc_id, r.n_bytes) for r in got) == bag((d, len((t or "").encode())) for d, t in rows)
    found, _, _ = slow_units(rows)
    groups = defaultdict(list)
    for w, place, end in found:
        groups[w].append((place, end))
    removed = defaultdict(set)
    ids = lambda place: (place[0], place[2])
    for members in groups.values():
        members.sort(key=lambda m: ids(m[0]))
        for place, end in members[1:]:
            removed[(place[0][1] if place[0][0] else None, place[1])].update(range(place[2], end))
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        data = (text or "").encode()
        gone = {k for s in r.removed for k in range(s.a, s.b)}
        assert gone == removed[(r.doc_id, text)], r.doc_id
        assert r.text == bytes(x for k, x in enumerate(data) if k not in gone).decode() and r.n_removed == len(gone)
    assert linededup.line_report(empty).count() == 0


# suffixes ---------------------------------------------------------------------------------------------------------


def test_suffix_removal(docs, rows, empty):
    data = [(d, (t or "").encode()) for d, t in rows]
    n = suffix.LENGTH
    count = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    want = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((d, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    assert bag(suffix.suffix_report(docs).collect()) == bag(want)
    assert suffix.suffix_report(empty).count() == 0


def test_suffix_removal_of_short_lengths(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = 9
    count = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    for r in suffix.remove_repeated_strings(df, length=n, gram=4, segment=2).collect():
        t = rows[r.doc_id][1]
        gone = {k for i in range(len(t) - n + 1) if count[t[i : i + n]] > 1 for k in range(i, i + n)}
        assert bytes(r.kept) == "".join(c for k, c in enumerate(t) if k not in gone).encode()
