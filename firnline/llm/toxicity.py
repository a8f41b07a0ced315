"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features are the words of a text, its neighbouring pairs and its pairs with one word between, each hashed to one of
2**18 places; a text has a place or not. Follow-the-regularised-leader keeps a rate per coordinate and an L1
penalty, so that all but a few weights are exactly zero; only those are broadcast. Training rows are dealt to
groups of bounded size that Spark fits side by side; their weights are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.textblocks import ALNUM, LOWER, blocks, mixed, prefix_hashes, span_hashes, word_spans

BITS = 18
#: Labelled rows that the model is fitted on at most (about), and the rows of each group that is fitted on its own.
TRAIN_ROWS, GROUP_ROWS = 32_000, 8_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 4.0, 0.0, 4
THRESHOLD = 0.3
PRIOR_CLEAN = 9.5


@dataclass(frozen=True)
class Model:
    bias: float
    places: np.ndarray  # sorted
    weights: np.ndarray


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of each word, pair and skip pair, repeats included."""
    lowered = LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets, ALNUM)
    keys = span_hashes(prefix_hashes(lowered), starts, ends)
    places, owners = [keys], [rows]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(keys) > gap:
            same = rows[gap:] == rows[:-gap]
            places.append(mixed(keys[:-gap] * np.uint64(salt) + keys[gap:])[same])
            owners.append(rows[gap:][same])
    return (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, start: float = 0.0) -> np.ndarray:
    """Weights by place (the bias, counted from ``start``, is last) after ``epochs`` runs over the examples in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for at, y in zip(examples, labels.tolist(), strict=True):
            at = np.append(at, bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-min(max(w.sum() + start, -30.0), 30.0))) - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(bias + 1))


def train(rows: DataFrame, limit: int = TRAIN_ROWS, group: int = GROUP_ROWS) -> Model:
    """Fits on text and toxic (0 or 1; others and null texts are left out) of at most about ``limit`` rows.

    The bias starts from the share of toxic labels, with ``PRIOR_CLEAN`` clean ones added, so that a few labels mark
    nothing; without any label every score is 0.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "text", F.col("toxic").cast("double").alias("y"))
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        return Model(-np.inf, np.zeros(0, np.int32), np.zeros(0))
    start = float(np.log((toxic + 0.5) / (n - toxic + PRIOR_CLEAN)))
    trainers = max(1, -(-min(n, limit) // group))
    draw = F.xxhash64("doc_id", "text")
    some = rows.where(F.pmod(draw, F.lit(1 << 30)) < int((1 << 30) * limit / n)) if n > limit else rows

    def extract(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(0)):
                places, owners = hashed_features(data, offsets)
                both = np.unique(owners.astype(np.int64) << BITS | places)
                cuts = np.searchsorted(both, np.arange(end - first + 1, dtype=np.int64) << BITS)
                values = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([values, batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first)], ["places", "y", "draw"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("y", "ascending")]).combine_chunks()
        lists = table.column("places").chunk(0) if table.column("places").num_chunks else pa.array([], pa.list_(pa.int32()))
        flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        w = ftrl([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], table.column("y").to_numpy(), start=start)
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(at.astype(np.int32)), "w": pa.array(w[at])})

    drawn = some.select("text", "y", draw.alias("draw")).mapInArrow(extract, "places array<int>, y double, draw long")
    fitted = drawn.groupBy(F.pmod(F.col("draw"), F.lit(trainers)).alias("trainer")).applyInArrow(fit, "place int, w double")
    found = fitted.groupBy("place").agg((F.sum("w") / F.lit(float(trainers))).alias("w")).orderBy("place").toArrow()  # 2**18 + 1 rows at most
    places, weights = found.column("place").to_numpy(), found.column("w").to_numpy()
    own = places < 1 << BITS
    return Model(start + float(weights[~own].sum()), places[own], weights[own])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) in place of any column of that name.

    A null or empty text has the score of no features. Repeated rows score the same, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "score")]
    schema = docs.select("text", *rest).schema.add("score", "double")

    def run(batches):
        m = shared.value
        table = np.zeros(1 << BITS)
        table[m.places] = m.weights
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(0)):
                places, owners = hashed_features(data, offsets)
                hit = np.flatnonzero(table[places])
                both = np.unique(owners[hit].astype(np.int64) << BITS | places[hit])
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], minlength=end - first) + m.bias
                s = 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40))) * np.isfinite(m.bias)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, end - first) for c in batch.columns], pa.array(s)], names=[*batch.schema.names, "score"])

    return docs.select("text", *rest).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of labelled documents outside the held-out fold (crc32(doc_id) mod 4 is 2)."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1)).distinct()
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(known, "doc_id")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have the score of no features, long ones are read whole, repeated rows score the same, rows
    with a null doc_id are scored but not learned from, labels other than 0 and 1 are ignored; an empty table gives no
    rows. Other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), train(labelled(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns (of any name) as they were.

    Rows are judged one by one as in ``score_documents``; without labels all of them stay.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "text")
    scored = score(own, train(labelled(docs, labels)))
    return scored.where(F.col("score") < THRESHOLD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
