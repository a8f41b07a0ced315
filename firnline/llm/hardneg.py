"""Hard negatives by bit-sliced integer products.

Components are integers. A candidate's are shifted to be unsigned and cut into bit-planes; a task adds the planes'
products with a block of anchors, most significant first. What the planes below may still add lies between sums over
an anchor's negative and positive components, so every score has an interval that halves with each plane, and a
candidate is dropped as soon as its interval cannot qualify: below the worst of the best so far, or outside the band.
Thresholds come from exact scores of rows the task has read before, so nothing that belongs to the result is dropped.

Anchors go to the tasks in blocks of bounded bytes, one after the other; all rows are read for each block where they
lie. A task returns at most a fixed number of rows for each anchor, and Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.storage import Scratch

#: Most anchors of a block, and most bytes of their components.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Anchors and candidates whose scores are held at a time.
TILE = (256, 512)
#: Pairs are followed one by one once fewer than this share of a tile is left.
SPARSE = 1 / 16
LOWEST = np.iinfo(np.int64).min


class Rules(NamedTuple):
    """Positives are the best ``positives`` rows of the anchor's label; a negative's score times 100 lies between ``low`` and ``high`` times the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def integer_vectors(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, x with x = floor(scale * component); see ``mine`` for the rows that take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("x")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.x")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` components; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


class Block:
    """Anchors of a block: ids, labels and components, with what unseen planes can add at most and at least."""

    def __init__(self, ids, labels, x, planes: int):
        self.ids, self.labels, self.planes = ids, labels, planes
        exact = np.float32 if np.abs(x).sum(axis=1, initial=0).max(initial=0) < 1 << 24 else np.float64
        self.x, self.base = x.astype(exact), -(x.sum(axis=1) << (planes - 1))
        self.up, self.down = np.where(x > 0, x, 0).sum(axis=1), np.where(x < 0, x, 0).sum(axis=1)

    def __getitem__(self, part) -> Block:
        out = object.__new__(Block)
        out.planes = self.planes
        for name in ("ids", "labels", "x", "base", "up", "down"):
            setattr(out, name, getattr(self, name)[part])
        return out


def scored(block: Block, slices: np.ndarray, alive: np.ndarray, hopeless) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and candidate numbers and exact scores of the pairs that stay.

    ``slices`` holds the candidates' bit-planes, most significant first; ``alive`` the pairs that take part.
    ``hopeless(rows, low, high)`` marks scores that cannot qualify: rows is None for a whole tile, else each pair's anchor.
    """
    total = np.repeat(block.base[:, None], alive.shape[1], axis=1)
    left = block.planes
    while left and alive.mean() > SPARSE:
        left -= 1
        total += (block.x @ slices[block.planes - 1 - left].T).astype(np.int64) << left
        rest = (1 << left) - 1
        alive &= ~hopeless(None, total + rest * block.down[:, None], total + rest * block.up[:, None])
    rows, cols = np.nonzero(alive)
    total = total[rows, cols]
    while left and len(rows):
        left -= 1
        total += np.einsum("ij,ij->i", block.x[rows], slices[block.planes - 1 - left][cols]).astype(np.int64) << left
        rest = (1 << left) - 1
        keep = ~hopeless(rows, total + rest * block.down[rows], total + rest * block.up[rows])
        rows, cols, total = rows[keep], cols[keep], total[keep]
    return rows, cols, total


class Best:
    """The best rows of each key: by score descending, then id ascending."""

    def __init__(self, keys: int, most: int):
        self.most, self.worst = most, np.full(keys, LOWEST)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key, score, ids) -> None:
        keep = score >= self.worst[key]
        if not keep.any():
            return
        key, score, ids = (np.concatenate([a, b[keep]]) for a, b in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.most
        self.key, self.score, self.id, rank = key[keep], score[keep], ids[keep], rank[keep]
        last = rank == self.most - 1
        self.worst[self.key[last]] = self.score[last]


def _tiles(batches, planes: int, dims: int, exact) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and bit-planes of at most ``TILE[1]`` candidates at a time."""
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        x = _matrix(batch.column(2), dims) + (1 << (planes - 1))
        for at in range(0, len(ids), TILE[1]):
            cut = slice(at, at + TILE[1])
            yield ids[cut], labels[cut], np.stack([(x[cut] >> j & 1).astype(exact) for j in range(planes - 1, -1, -1)])


def _positives(block: Block, dims: int, rules: Rules):
    def run(batches):
        parts = [block[np.flatnonzero(block.labels == k)[at : at + TILE[0]]] for k in np.unique(block.labels) for at in range(0, int((block.labels == k).sum()), TILE[0])]
        best = [Best(len(p.ids), rules.positives) for p in parts]
        for ids, labels, slices in _tiles(batches, block.planes, dims, block.x.dtype):
            for part, held in zip(parts, best, strict=True):
                same = np.flatnonzero(labels == part.labels[0])
                if not len(same):
                    continue

                def hopeless(rows, low, high, held=held):
                    return high < (held.worst[:, None] if rows is None else held.worst[rows])

                rows, cols, score = scored(part, slices[:, same], part.ids[:, None] != ids[same], hopeless)
                held.add(rows, score, ids[same][cols])
        for part, held in zip(parts, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(part.ids[held.key], pa.int64()), pa.array(held.id, pa.int64()), pa.array(held.score, pa.int64())], ["anchor_id", "vec_id", "score"])

    return run


def _bands(positives: list[list[tuple[int, int]]], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Least and most of a hundred times a negative's score, for each anchor and positive; the band of one that is missing is empty."""
    floor, top = np.ones((len(positives), rules.positives), np.int64), np.zeros((len(positives), rules.positives), np.int64)
    for row, own in enumerate(positives):
        for k, (_, score) in enumerate(own):
            floor[row, k], top[row, k] = rules.low * score, rules.high * score
    return floor, top


def _negatives(block: Block, positives: dict[int, list[tuple[int, int]]], dims: int, rules: Rules):
    p = rules.positives

    def run(batches):
        parts = [block[at : at + TILE[0]] for at in range(0, len(block.ids), TILE[0])]
        best = [Best(len(q.ids) * p, rules.negatives) for q in parts]
        floors, tops = zip(*(_bands([positives.get(i, []) for i in q.ids.tolist()], rules) for q in parts), strict=True) if parts else ((), ())
        for ids, labels, slices in _tiles(batches, block.planes, dims, block.x.dtype):
            for part, held, floor, top in zip(parts, best, floors, tops, strict=True):
                worst = held.worst.reshape(-1, p)

                def hopeless(rows, low, high, worst=worst, floor=floor, top=top):
                    # at least: the band's floor and the worst of the best so far; at most: the band's top
                    least, most = np.maximum(-(-floor // 100), worst), top // 100
                    least = np.where(least > most, np.iinfo(np.int64).max, least)
                    out = np.ones(low.shape, bool)
                    for k in range(p):
                        a, b = (least[:, k, None], most[:, k, None]) if rows is None else (least[rows, k], most[rows, k])
                        out &= (high < a) | (low > b)
                    return out

                rows, cols, score = scored(part, slices, part.labels[:, None] != labels, hopeless)
                fits = (100 * score[:, None] >= floor[rows]) & (100 * score[:, None] <= top[rows]) & (floor[rows] <= top[rows])
                pair, k = np.nonzero(fits)
                held.add(rows[pair] * p + k, score[pair], ids[cols[pair]])
        for part, held in zip(parts, best, strict=True):
            own = [positives.get(i, []) for i in part.ids.tolist()]
            chosen = [own[k // p][k % p] for k in held.key.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (part.ids[held.key // p], [i for i, _ in chosen], [s for _, s in chosen], held.id, held.score)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return run


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, rules: Rules = Rules(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``integer_vectors``.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part. Of rows
    with one vec_id the least by label, then by components, stands for it, so repeated rows count once. Ties go by
    smaller vec_id. Vectors of different lengths meet as if the shorter ended in zeros; an empty one scores 0. An
    anchor without positives, or a positive without negatives, gives no rows; no vectors or no anchors, none at all.
    Scores that might not fit in a long are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    vectors = scratch.put(vectors.repartition(tasks, "vec_id"), "vectors")
    largest = F.max(F.array_max(F.transform("x", lambda v: F.greatest(v, -v - 1))))
    stats = vectors.agg(F.count_if(is_anchor).alias("n"), largest.alias("most"), F.max(F.size("x")).alias("dims")).first()
    dims, planes = stats.dims or 0, int(stats.most or 0).bit_length() + 1
    if dims << 2 * planes >= 1 << 55:
        raise ValueError(f"{dims} components of {planes} bits: scores may not fit in a long")
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, dims))))
    results, blocks = [], -(-stats.n // max(1, most // 2))  # half full on average, since hashes deal them out
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))
    for k in range(blocks):
        rows = vectors.where(is_anchor & (number == k)).select("vec_id", "label", "x").limit(most + 1).toArrow()
        if len(rows) > most:
            raise ValueError("a block of anchors is over twice its expected size")
        if not len(rows):
            continue
        block = Block(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["x"], dims), planes)
        found = vectors.mapInArrow(_positives(block, dims, rules), "anchor_id long, vec_id long, score long")
        found = _best(found, ["anchor_id"], rules.positives).orderBy("anchor_id", "rank").select("anchor_id", "vec_id", "score").toArrow().to_pylist()  # at most ``positives`` for each of the block's anchors
        positives: dict[int, list[tuple[int, int]]] = {}
        for r in found:
            positives.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        found = vectors.mapInArrow(_negatives(block, positives, dims, rules), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
        scratch.put(_best(found, ["anchor_id", "positive_id", "positive_score"], rules.negatives), f"block{k}")
        results.append(scratch.path(f"block{k}"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not results:
        return spark.createDataFrame([], schema)
    out = spark.read.parquet(*results)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The query's rules: labels of every seventh vec_id are moved on by one, every hundredth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(integer_vectors(embeddings, label), F.col("vec_id") % 100 == 0)
