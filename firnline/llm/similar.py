"""Near duplicates by the Jaccard similarity of word shingles.

A document is its set of distinct five-word shingles; only a real similarity of ``LEAST`` or more links. Candidates come
in two steps, of which each leaves out what is linked already:

1. SimHash fingerprints of the sets, by the pivot tables of ``simhash``: pairs at most two bits apart, which are the
   near-identical texts. Two bits miss most pairs near 0.8 (these differ in about ten).
2. Bands of MinHash values for the rest. With 32 bands of four values a pair of similarity 0.8 fails to meet with
   probability (1 - 0.8 ** 4) ** 32 < 5e-8. Small bands are compared pair by pair. The members of a larger one are
   compared with its centre (the member that has most company in all its bands), and what is then outside its largest
   component with all of its members, so that no pair of different components goes unseen.

In that last step the real sets meet only after a bound that is never wrong: shingles fall in 1024 places, of which each
keeps the parity of its count, and two sets differ in as many shingles at least as in places.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm import simhash
from firnline.llm.components import components
from firnline.llm.simhash import numbered_rows, one_row_per_root
from firnline.llm.storage import Scratch
from firnline.llm.textblocks import blocks, mixed

SHINGLE_WORDS = 5
#: The least similarity, as a fraction: exact in whole numbers.
LEAST = (4, 5)
BANDS, BAND_VALUES = 32, 4
SEED = 42
#: Bands of up to so many members are compared pair by pair.
SMALL_BAND = 16
#: Parity words of a set, of 64 places each.
PARITY = 16
_KEYS = mixed(np.arange(1, BANDS * BAND_VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one for a text of fewer words, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(b" ".join(words), SEED)], np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.unique(np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row of band keys for each set; sets are runs of ``hashes`` that begin at ``cuts`` and are not empty."""
    out = np.zeros((len(cuts), BANDS), np.uint64)
    for k, key in enumerate(_KEYS):
        least = np.minimum.reduceat((hashes ^ key) * (key | np.uint64(1)), cuts)
        out[:, k // BAND_VALUES] = mixed(out[:, k // BAND_VALUES] ^ least) + np.uint64(k)
    return out


def parities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``PARITY`` words for each set; sets are runs of ``hashes`` of the given sizes."""
    out = np.zeros((len(sizes), PARITY), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    np.bitwise_xor.at(out, (owner, ((hashes >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)), np.uint64(1) << (hashes & np.uint64(63)))
    return out


def shingle_sets(rows: DataFrame) -> DataFrame:
    """_row, set (16 bytes that name the set), n, fp, p0 and so on and band keys of every row (_row, text).

    The shingles themselves would take more room than the texts; ``shingle_lists`` makes them again for rows in pairs.
    """

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                sets = [shingles(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                sizes = np.array([len(s) for s in sets], np.int64)
                hashes = np.concatenate(sets)
                places = np.cumsum(sizes) - sizes
                full = np.flatnonzero(sizes)
                keys = band_keys(hashes, places[full]) if len(full) else np.zeros((0, BANDS), np.uint64)
                key_places = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(key_places), pa.array(keys.ravel().view(np.int64)))
                names = pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary())
                fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
                words = parities(hashes, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), names, pa.array(sizes.astype(np.int32)), pa.array(fps), *map(pa.array, words.T.copy()), lists], columns)

    parity = [f"p{i}" for i in range(PARITY)]
    columns = ["_row", "set", "n", "fp", *parity, "keys"]
    return rows.select("_row", "text").mapInArrow(run, f"_row long, set binary, n int, fp long, {', '.join(f'{p} long' for p in parity)}, keys array<long>")


def shingle_lists(rows: DataFrame) -> DataFrame:
    """_row and shingles (distinct hashes) of every row (_row, text)."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                sets = [shingles(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))], ["_row", "shingles"])

    return rows.select("_row", "text").mapInArrow(run, "_row long, shingles array<long>")


def _sizes_allow(x, y):
    return F.least(x, y).cast("long") * LEAST[1] >= F.greatest(x, y).cast("long") * LEAST[0]


def similar(pairs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs a, b whose sets have a Jaccard similarity of ``LEAST`` or more. rows: _row, text."""
    pairs = scratch.put(pairs, f"{name}_pairs")
    ids = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), f"{name}_ids")
    needed = scratch.put(shingle_lists(rows.join(ids, "_row", "left_semi")), f"{name}_sets")
    one, two = (needed.select(F.col("_row").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    enough = both * LEAST[1] >= (F.size("of_a") + F.size("of_b") - both) * LEAST[0]
    links = scratch.put(pairs.join(two, "b").join(one, "a").where(enough).select("a", "b"), name)
    scratch.drop(f"{name}_ids", f"{name}_sets")
    return links


def _differing():
    """The least number of shingles in which x and y differ, by their parities."""
    return reduce(lambda acc, d: acc + d, [F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITY)])


def _rooted(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """_row and label after further links a, b; rows that are not in ``labels`` are their own label."""
    if labels is None:
        return scratch.put(components(links, Scratch(scratch.spark, name)).select(F.col("node").alias("_row"), F.col("root").alias("label")), name)
    ends = links
    for c in "ab":
        ends = ends.join(labels.select(F.col("_row").alias(c), F.col("label").alias(f"l{c}")), c, "left")
    la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
    between = ends.select(F.least(la, lb).alias("a"), F.greatest(la, lb).alias("b")).where("a < b").distinct()
    moved = components(between, Scratch(scratch.spark, name))
    old = labels.join(moved.withColumnRenamed("node", "label"), "label", "left").select("_row", F.coalesce("root", "label").alias("label"))
    fresh = moved.select(F.col("node").alias("_row"), F.col("root").alias("label")).join(labels, "_row", "left_anti")
    return scratch.put(old.unionByName(fresh), name)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "_row", "left").withColumn("label", F.coalesce("label", "_row"))


def similar_roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """_row and _root (the least row that it reaches over links) of every row (_row, text)."""
    found = scratch.put(shingle_sets(rows), "sets")
    reps = scratch.put(found.groupBy("set").agg(F.min("_row").alias("rep")), "reps")
    heads = found.join(reps.select(F.col("rep").alias("_row")), "_row", "left_semi")

    fps = scratch.put(heads.groupBy("fp").agg(F.min("_row").alias("least")), "fps")
    equal = heads.select("_row", "fp").join(fps, "fp").where("_row > least").select(F.col("least").alias("a"), F.col("_row").alias("b"))
    of = lambda c: fps.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    near = simhash.links(fps.select("fp"), scratch).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of("a"), "fp_a").join(of("b"), "fp_b")
    first = similar(equal.unionByName(near.select("a", "b")), rows, scratch, "first_links")
    labels = _rooted(None, first, scratch, "first_labels")

    members = scratch.put(_labelled(heads.select("_row", "n", F.explode("keys").alias("key")), labels), "members")
    bands = scratch.put(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bands")
    met = scratch.put(members.join(bands, "key"), "met")
    scratch.drop("members")
    listed = met.where(F.col("m") <= SMALL_BAND).groupBy("key").agg(F.collect_list(F.struct("_row", "n", "label")).alias("of"))
    wanted = lambda x, y: (x["_row"] < y["_row"]) & (x["label"] != y["label"]) & _sizes_allow(x["n"], y["n"])
    each = F.flatten(F.transform("of", lambda x: F.transform(F.filter("of", lambda y: wanted(x, y)), lambda y: F.struct(x["_row"].alias("a"), y["_row"].alias("b")))))
    small = listed.select(F.explode(each).alias("p")).select("p.a", "p.b")
    large = met.where(F.col("m") > SMALL_BAND).drop("label")
    company = scratch.put(large.groupBy("_row").agg(F.sum("m").alias("company")), "company")
    ranked = scratch.put(_labelled(large.join(company, "_row"), labels), "ranked")
    centres = scratch.put(ranked.groupBy("key").agg(F.max(F.struct("company", F.negative("_row").alias("_"), F.struct("_row", "n", "label").alias("c"))).alias("top")).select("key", "top.c"), "centres")
    stars = ranked.join(centres, "key").where((F.col("label") != F.col("c.label")) & _sizes_allow(F.col("n"), F.col("c.n"))).select(F.least("_row", "c._row").alias("a"), F.greatest("_row", "c._row").alias("b"))
    pairs = scratch.put(small.unionByName(stars).distinct(), "pairs")
    scratch.drop("met", "bands", "company", "centres")
    labels = _rooted(labels, similar(pairs, rows, scratch, "links"), scratch, "labels")

    placed = scratch.put(_labelled(ranked.select("key", "_row", "n"), labels), "placed")
    per = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    most = scratch.put(per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("top")), "most")
    open_bands = scratch.put(placed.join(most, "key").join(found.select("_row", *[f"p{i}" for i in range(PARITY)]), "_row"), "open_bands")
    outside = scratch.put(open_bands.where("label <> top"), "outside")
    # a similarity of t needs at most (1 - t) / (1 + t) of both sizes as differing shingles
    allowed = (F.col("x.n") + F.col("y.n")).cast("long") * (LEAST[1] - LEAST[0])
    across = open_bands.alias("x").join(outside.alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("x.label") != F.col("y.label")) & _sizes_allow(F.col("x.n"), F.col("y.n")) & (_differing() * (LEAST[0] + LEAST[1]) <= allowed))
    more = scratch.put(across.select(F.least("x._row", "y._row").alias("a"), F.greatest("x._row", "y._row").alias("b")).distinct(), "more_pairs").join(pairs, ["a", "b"], "left_anti")
    labels = _rooted(labels, similar(more, rows, scratch, "more_links"), scratch, "last_labels")
    named = reps.join(labels.withColumnRenamed("_row", "rep"), "rep", "left").select("set", F.coalesce("label", "rep").alias("_root"))
    return found.select("_row", "set").join(named, "set").select("_row", "_root")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of documents linked by shingle similarity, whatever the doc_ids; columns stay.

    Null, empty and wordless texts are one component, as are texts of equal shingle sets and repeated rows; a text of
    fewer than five words is one shingle. An empty table stays empty. The row that stays is the least by doc_id (null
    last), content and other columns.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = numbered_rows(docs, scratch)
    return one_row_per_root(rows, similar_roots(rows.select("_row", F.col("_own.text").alias("text")), scratch))
