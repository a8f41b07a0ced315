"""Near duplicates by SimHash fingerprints, found through a table of pivot distances.

Each distinct fingerprint gets its Hamming distances to reference fingerprints: a base pivot, the 64 *near* pivots one
bit away from it, and 32 *far* pivots spread over the space. Fingerprints at most ``MAX_BITS`` = 2 bits apart agree in
all near coordinates but two, taken relative to the base, so in all of at least four of six groups of them: equal
coordinates in four groups make a block. All distances are worked out once for each fingerprint and stored: the near
ones, relative to the base, as the bits of one number. A block of over ``SMALL_SET`` members is dealt by more coordinates, as often as
it takes: its open ones are cut in three, of which one at least is equal in every pair that links. Of each block's
pairs those with a difference of over ``MAX_BITS`` in any stored far coordinate are discarded, and the survivors verified.
A block with five open coordinates has 32 members at most, so the dealing ends after four rounds.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.components import components
from firnline.llm.storage import Scratch
from firnline.llm.textblocks import mixed, whole_bytes

MAX_BITS = 2
SEED = 42
BASE_PIVOT = 0x5BD1E995A7C3F021
NEAR, FAR = 64, 32
GROUPS, EQUAL_GROUPS = 6, 4
#: Blocks of up to so many members have their pairs compared, as have those of up to so many open coordinates.
SMALL_SET, LEAST_OPEN = 32, 5
_ROWS = 1 << 15


def fingerprint(text: bytes, size: int = 3) -> int:
    """The unsigned fingerprint of a text's word shingles; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the white space 0x20, 0x09 to 0x0D
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -size].tolist()]
    return majority(np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        ones += np.unpackbits(hashes[at : at + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fingerprint (long, the unsigned value's two's complement) of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = whole_bytes(batch.column(1))
            raw, at = data.tobytes() if len(data) else b"", offsets.tolist()
            values = [fingerprint(raw[a:b], size) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NEAR_PIVOTS = [_signed(BASE_PIVOT ^ mask) for mask in [0, *(1 << b for b in range(NEAR))]]
FAR_PIVOTS = mixed(np.arange(1, FAR + 1, dtype=np.uint64) * np.uint64(BASE_PIVOT)).view(np.int64).tolist()
#: The near coordinates of each group.
GROUP_OF = [list(range(g, NEAR, GROUPS)) for g in range(GROUPS)]


def distances(fp: Column, pivots: list[int]) -> Column:
    return F.transform(F.lit(pivots), lambda p: F.bit_count(fp.bitwiseXOR(p)))


def near_coordinates(fp: Column) -> Column:
    """The distances to the near pivots, each less that to the base (one more or one less), as the bits of a number, the first highest."""
    bit = lambda x, base: F.when(x > base, 1).otherwise(0).cast("long")
    packed = lambda d: F.aggregate(F.slice(d, 2, NEAR), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(bit(x, F.get(d, F.lit(0)))))
    return F.get(F.transform(F.array(distances(fp, NEAR_PIVOTS)), packed), F.lit(0))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp, near (a number) and far (distances to the far pivots) of each fingerprint: worked out once, and stored."""
    return distinct.select("fp", near_coordinates(F.col("fp")).alias("near"), F.transform(distances(F.col("fp"), FAR_PIVOTS), lambda d: d.cast("byte")).alias("far"))


def _numbers(of: list[int]) -> Column:
    return F.lit(of).cast("array<int>")


def _coordinates(of: Column) -> Column:
    """The near coordinates of the given numbers as one number."""
    return F.aggregate(of, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.getbit(F.col("near"), F.lit(NEAR - 1) - i).cast("long")))


def blocked(table: DataFrame) -> DataFrame:
    """fp, near, key and open (numbers of the coordinates not in the key) for each choice of four coordinate groups."""
    choices = [(sorted(j for g in chosen for j in GROUP_OF[g]), [j for g in range(GROUPS) if g not in chosen for j in GROUP_OF[g]]) for chosen in combinations(range(GROUPS), EQUAL_GROUPS)]
    mask = lambda held: _signed(sum(1 << (NEAR - 1 - j) for j in held))
    keys = F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("near").bitwiseAND(F.lit(mask(held)))).alias("key"), _numbers(rest).alias("open")) for i, (held, rest) in enumerate(choices)])
    return table.select("fp", "near", F.explode(keys).alias("k")).select("fp", "near", "k.key", "k.open")


def dealt(crowded: DataFrame) -> DataFrame:
    """The rows of crowded blocks by the three thirds of their open coordinates."""
    size, n = F.col("open"), F.size("open")
    cut = [F.lit(0), F.ceil(n / F.lit(3)).cast("int"), F.ceil(F.lit(2) * n / F.lit(3)).cast("int"), n]
    part = lambda i: F.slice(size, cut[i] + F.lit(1), cut[i + 1] - cut[i])
    keys = [F.struct(F.xxhash64("key", F.lit(i), _coordinates(part(i))).alias("key"), F.concat(*[part(j) for j in range(3) if j != i]).alias("open")) for i in range(3)]
    return crowded.select("fp", "near", F.explode(F.array(*keys)).alias("k")).select("fp", "near", "k.key", "k.open")


def links(distinct: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges a < b between all fingerprints at most two bits apart."""
    scratch = scratch or Scratch(distinct.sparkSession, "simhash-links")
    table = scratch.put(pivot_table(distinct.select("fp")), "pivots")
    rows = blocked(table.select("fp", "near"))
    found, level = None, 0
    while True:
        counted = scratch.put(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("open")).alias("left")).where("n > 1"), f"blocks{level}")
        few = (F.col("n") <= SMALL_SET) | (F.col("left") <= LEAST_OPEN)
        small = rows.join(counted.where(few).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("m"))
        pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter(F.col("m"), lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        met = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
        found = met if found is None else found.unionByName(met)
        full = counted.where(~few).select("key")
        if full.isEmpty():
            break
        rows = scratch.put(dealt(rows.join(full, "key")), f"dealt{level}")
        level += 1
    one, two = (table.select(F.col("fp").alias(c), F.col("far").alias(f"far_{c}")) for c in "ab")
    apart = F.array_max(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    kept = found.distinct().join(one, "a").join(two, "b").where(apart <= MAX_BITS)
    return kept.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def simhash_groups(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id for every row.

    A null, empty or wordless text has fingerprint zero and links like any other; a null doc_id keeps its row, and
    names a component only if no other document is in it (then null). Repeated rows share a component.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.put(fingerprints(docs, size), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    found = components(links(distinct.select("fp"), scratch), scratch)
    root = F.coalesce("root", "fp")
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root.alias("root"), "least_doc")
    named = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_row (a number) and _own (the row as it is) of every row, written so that the numbers stay."""
    return scratch.put(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")), "rows")


def one_row_per_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each root one row: the least by doc_id (null last), content, other columns and number. roots: _row, _root."""
    names = [c for c in rows.schema["_own"].dataType.names if c not in ("doc_id", "text")]
    other = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col("_own")[c].alias(f"c{i}") for i, c in enumerate(names)]))
    place = F.struct(F.col("_own.doc_id").isNull().alias("no_id"), F.col("_own.doc_id").alias("doc_id"), F.xxhash64("_own.text").alias("content"), F.xxhash64(other).alias("other"), "_row")
    least = rows.select("_row", place.alias("_place")).join(roots, "_row").groupBy("_root").agg(F.min("_place").alias("_place"))
    return rows.join(least.select("_place._row"), "_row", "left_semi").select("_own.*")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of fingerprints, whatever the doc_ids in it; the columns stay as they are.

    Null, empty and wordless texts are one component, as are repeated rows. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "simhash-rows")
    rows = numbered_rows(docs, scratch)
    marked = scratch.put(fingerprints(rows.select(F.col("_row").alias("doc_id"), F.col("_own.text").alias("text"))), "fingerprints").select(F.col("doc_id").alias("_row"), "fp")
    found = components(links(marked.select("fp").distinct(), scratch), scratch)
    roots = marked.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("_row", F.coalesce("root", "fp").alias("_root"))
    return one_row_per_root(rows, roots)
