"""Removing repeated byte strings by bucket-pointer refinement of sampled suffixes.

A suffix array of every byte would be many times the text, so only suffixes at *anchors* are bucketed. Every string
of ``LENGTH`` bytes holds a q-gram of least hash; the first such place is its anchor, and it depends on the
string's bytes alone, so equal strings have equal anchors. Neighbouring strings mostly share an anchor: a *run* is
a stretch of start positions with one anchor.

*Buckets.* A start position has a bucket identifier at growing reach. The first is its q-gram's. Refining doubles the
reach: the next identifier is the name of the pair of the last one and the one that far on, 32 + 32, 64 + 64, and last
128 bytes with 128 that begin 72 on, 200 in all; each round reads the identifiers of the round before (``reach_ids``).
A pair is named by its hash, so that every task gives it the same name without a common table, and Spark's grouping by
names does what sorting by identifiers does elsewhere. A range of start positions is the pair of the identifiers at its
first and its last start, which cover all its bytes between them.

*Refinement.* 1. Runs are bucketed by the q-gram at their anchor; buckets of one run hold nothing repeated. 2. The rest
are refined by the identifiers of their ranges. Ranges of which there are two or more are wholly repeated. 3. A range
that stays alone though its bucket has others (the ends of shared passages) is unsettled: one range of each kind, with
the size of the kind, is cut at fixed distances from the anchor into shorter ones, and step 2 is done again on these,
first of ``SEGMENT`` starts, then of one. A short range whose common core is found once holds nothing repeated.

Every step is a count by key, which Spark adds up before shuffling, written as a table, and joins with that table,
which Spark splits where one key has very many rows; no bucket is ever collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.cutting import cut_spans
from firnline.llm.storage import Scratch
from firnline.llm.textblocks import BASE, blocks, mixed, prefix_hashes, span_hashes, whole_bytes

LENGTH, GRAM, SEGMENT = 200, 32, 16


def named(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The names of pairs of bucket identifiers."""
    return mixed(x * np.uint64(BASE) + y)


def reach_ids(grams: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The bucket identifier of each place at a reach of ``length`` bytes, from those of its q-gram."""
    ids, reach = grams, gram
    while reach < length:
        step = min(reach, length - reach)
        ids, reach = named(ids[:-step], ids[step:]), reach + step
    return ids


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, a, b (first and last start in the row), m (the anchor's hash) and key (names the range a to b)."""
    empty = {"row": np.zeros(0, np.int64), "a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32), "m": np.zeros(0, np.uint64), "key": np.zeros(0, np.uint64)}
    if len(data) < length:
        return empty
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hashes(prefix, at, at + gram)
    least = _least(grams, length - gram + 1)
    inside = np.ones(len(least), bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(fresh & inside)
    if not len(starts):
        return empty
    rows = np.searchsorted(offsets, starts, side="right") - 1
    last = np.minimum(np.append(starts[1:], len(data)) - 1, offsets[rows + 1] - length)
    ids = reach_ids(grams, length, gram)
    key = named(named(ids[starts], ids[last]), (last - starts).astype(np.uint64))
    return {"row": rows, "a": (starts - offsets[rows]).astype(np.int32), "b": (last - offsets[rows]).astype(np.int32), "m": least[starts], "key": key}


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(2)):
                r = runs_of(data, offsets, length, gram)
                rows = pa.array(r["row"] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(r["a"]), pa.array(r["b"]), pa.array(r["m"].view(np.int64)), pa.array(r["key"].view(np.int64))], ["doc_id", "content", "a", "b", "m", "key"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content long, a int, b int, m long, key long")


def segments_of(data: np.ndarray, offsets: np.ndarray, m: np.ndarray, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> dict[str, np.ndarray]:
    """row, seg, core, span, lo, hi of each segment of runs, given the bytes that a run's strings cover.

    Start positions lo up to hi are counted in the run. The core names what all strings of the full segment share (by
    the q-grams at its ends and the bytes between); the span names the range of starts and its place in the segment.
    """
    sizes = np.diff(offsets)
    counts = sizes - length + 1
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hashes(prefix, at, at + gram)
    ids = reach_ids(grams, length, gram)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    rel = at - offsets[row]
    found = np.flatnonzero((rel >= counts[row] - 1) & (rel + gram <= sizes[row]))
    found = found[grams[found] == m[row[found]]]
    rows, first = np.unique(row[found], return_index=True)
    anchor = rel[found[first]]  # one for each row: every run has its anchor in its bytes
    assert len(rows) == len(sizes), "a run lacks its anchor"
    owner = np.repeat(rows, counts)
    s = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    number = (anchor[owner] - s) // segment
    new = np.append(True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(owner)) - 1
    r, lo, hi, k = owner[heads], s[heads], s[tails] + 1, number[heads]
    base = offsets[r]
    core = span_hashes(prefix, base + anchor[r] - k * segment, base + anchor[r] - (k + 1) * segment + 1 + length)
    span = named(named(ids[base + lo], ids[base + hi - 1]), (hi - lo).astype(np.uint64)) ^ (anchor[r] - lo).astype(np.uint64)
    return {"row": r, "seg": k, "core": core, "span": span, "lo": lo, "hi": hi}


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """doc_id, content, a, m, n, bytes of each run in the list rs of its document."""

    def run(batches):
        for batch in batches:
            data, offsets = whole_bytes(batch.column(2))
            lists = batch.column(3)
            m, n, a, b = (x.to_numpy() for x in lists.values.flatten())
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            texts = [data[x:y].tobytes() for x, y in zip((offsets[rows] + a).tolist(), (offsets[rows] + b + length).tolist(), strict=True)]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a), pa.array(m), pa.array(n), pa.array(texts, pa.binary())], ["doc_id", "content", "a", "m", "n", "bytes"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, content long, a int, m long, n long, bytes binary")


def _segments(contexts: DataFrame, length: int, gram: int, segment: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(5)):
                m = batch.column(3).slice(first, end - first).to_numpy().view(np.uint64)
                x = segments_of(data, offsets, m, length, gram, segment)
                at = pa.array(x["row"] + first)
                same = [batch.column(i).take(at) for i in (0, 1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(x[c].astype(np.int32)) for c in ("seg", "lo", "hi")], *[pa.array(x[c].view(np.int64)) for c in ("core", "span")]], ["doc_id", "content", "a", "m", "n", "seg", "lo", "hi", "core", "span"])

    return contexts.mapInArrow(run, f"doc_id {contexts.schema['doc_id'].dataType.simpleString()}, content long, a int, m long, n long, seg int, lo int, hi int, core long, span long")


def _narrowed(joined: DataFrame, length: int) -> DataFrame:
    """doc_id, content, a, m, n, bytes of the ranges in the list segs (lo, hi, t) of a run."""

    def run(batches):
        for batch in batches:
            data, offsets = whole_bytes(batch.column(4))
            lists = batch.column(5)
            lo, hi, n = (x.to_numpy().astype(np.int64) for x in lists.values.flatten())
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            texts = [data[x:y].tobytes() for x, y in zip((offsets[rows] + lo).tolist(), (offsets[rows] + hi - 1 + length).tolist(), strict=True)]
            at = pa.array(rows)
            a = batch.column(2).take(at).to_numpy() + lo
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a.astype(np.int32)), batch.column(3).take(at), pa.array(n), pa.array(texts, pa.binary())], ["doc_id", "content", "a", "m", "n", "bytes"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, content long, a int, m long, n long, bytes binary")


def _same(doc, content):
    return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("content") == F.col(content))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """doc_id, content, spans (array of a and b: bytes a up to b, which may overlap) of documents that hold repeats.

    ``docs`` has doc_id, content (a long that tells the texts of one doc_id apart) and text.
    """
    count = F.count(F.lit(1)).alias("n")
    found = lambda df, b: df.select("doc_id", "content", "a", (b + F.lit(length)).alias("b"))
    runs = scratch.put(_runs(docs, length, gram), "runs")
    crowded = scratch.put(runs.groupBy("m").agg(count).where("n > 1").select("m"), "crowded")
    shared = scratch.put(runs.join(crowded, "m"), "shared")
    scratch.drop("runs")
    classes = scratch.put(shared.groupBy("m", "key").agg(count, F.min(F.struct("doc_id", "content", "a", "b")).alias("rep")), "classes")
    repeated = [scratch.put(found(shared.join(classes.where("n > 1").select("m", "key"), ["m", "key"]), F.col("b")), "whole")]
    scratch.drop("shared", "crowded")

    unsettled = scratch.put(classes.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("m"), "unsettled")
    reps = classes.join(unsettled, "m").select("rep.doc_id", "rep.content", F.struct("m", "n", "rep.a", "rep.b").alias("r"))
    by_doc = reps.groupBy(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).agg(F.collect_list("r").alias("rs"))  # runs of one document
    contexts = scratch.put(_contexts(docs.join(by_doc, _same("_d", "_c")).select("doc_id", "content", "text", "rs"), length), "contexts")
    scratch.drop("classes")
    ids, place = ["m", "seg", "core", "span"], F.struct("doc_id", "content", "a", "lo")
    for k, step in enumerate((segment, 1)):
        parts = scratch.put(_segments(contexts, length, gram, step), f"parts{k}")
        kinds = scratch.put(parts.groupBy(*ids).agg(F.sum("n").alias("t"), F.min(place).alias("rep")), f"kinds{k}")
        again = parts.where("n = 1").join(kinds.where("t > 1").select(*ids), ids)
        repeated.append(scratch.put(again.select("doc_id", "content", (F.col("a") + F.col("lo")).alias("a"), (F.col("a") + F.col("hi") - 1 + F.lit(length)).alias("b")), f"inside{k}"))
        if step > 1:
            mixed_cores = scratch.put(kinds.groupBy("m", "seg", "core").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("least")).where("c > 1 and least = 1").select("m", "seg", "core"), f"cores{k}")
            probes = kinds.join(mixed_cores, ["m", "seg", "core"]).select("t", "rep.*").select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), F.col("a").alias("_a"), F.col("lo").alias("_l"), "t")
            wanted = parts.select("doc_id", "content", "a", "lo", "hi").join(probes, _same("_d", "_c") & (F.col("a") == F.col("_a")) & (F.col("lo") == F.col("_l")))
            by_run = wanted.groupBy("_d", "_c", "_a").agg(F.collect_set(F.struct("lo", "hi", "t")).alias("segs"))  # a run has few segments
            few = contexts.join(by_run, _same("_d", "_c") & (F.col("a") == F.col("_a"))).select("doc_id", "content", "a", "m", "bytes", "segs")
            contexts = _narrowed(few, length)
        else:
            scratch.drop("contexts", *[f"{t}{i}" for t in ("parts", "kinds", "cores") for i in range(k + 1)])
    return reduce(DataFrame.unionByName, repeated).groupBy("doc_id", "content").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, removed (array of a and b), kept (binary) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it starts at two places or more of the table. A null text
    is empty. Repeated rows are copies like any other. Long texts are taken whole, other columns are not read, and an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text")).alias("content"), "text")
    return cut_spans(keyed, repeated_spans(keyed, scratch, length, gram, segment))


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeated_strings(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
