"""Cutting byte spans out of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.textblocks import SPACE, whole_bytes

SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32())])


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by the given ones; spans that touch are one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def long_runs(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the merged spans with nothing but white space between, if of ``least`` bytes or all of the text's words."""
    upto = np.append(0, np.cumsum(~SPACE[text]))
    new = np.append(True, upto[a[1:]] > upto[b[:-1]])
    first, last = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    good = (last - first >= least) | (upto[last] - upto[first] == upto[-1])
    return first[good], last[good]


def cut_spans(docs: DataFrame, spans: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_found, removed (array of a and b), kept (binary) of every row of docs (doc_id, content, text).

    ``spans`` has doc_id, content and spans, at most one row for each; a document without one keeps all its bytes.
    n_found is the number of bytes in spans. With ``least`` only the runs of ``long_runs`` are removed.
    """

    def run(batches):
        for batch in batches:
            data, offsets = whole_bytes(batch.column(1))
            lists = batch.column(2)
            flat, cuts = lists.values.flatten(), lists.offsets.to_numpy()
            starts, stops = flat[0].to_numpy(), flat[1].to_numpy()
            kept, sizes, inside, first, second, counts = [], [], [], [], [], []
            for i in range(batch.num_rows):
                a, b = merged(starts[cuts[i] : cuts[i + 1]], stops[cuts[i] : cuts[i + 1]])
                text = data[offsets[i] : offsets[i + 1]]
                inside.append(int((b - a).sum()))
                if least and len(a):
                    a, b = long_runs(text, a, b, least)
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                first.append(a), second.append(b), counts.append(len(a))
            none = np.zeros(0, np.int32)
            both = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *first]).astype(np.int32)), pa.array(np.concatenate([none, *second]).astype(np.int32))], fields=list(SPAN))
            removed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), both)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(inside, pa.int64()), removed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_found", "removed", "kept"])

    found = spans.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "spans")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("content") == F.col("_c")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"))
    return some.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_found long, removed array<struct<a:int,b:int>>, kept binary")
