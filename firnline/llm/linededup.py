"""Removing repeated lines and sentences: the earliest occurrence stays, the rest goes, offsets are kept.

Units are lines, and the sentences of lines that have several, whatever their length. A unit is normalised to its
words (letters and digits, A-Z in lower case) and known by two rolling hashes of 61 bits, each over word hashes of its
own, modulo a prime and with bases that the driver draws for each run, so that no text can be written to collide; the
words of a line without letters and digits are its runs between white space. Only blank lines, and sentences without letters
and digits, are no units. Occurrences are ranked by doc_id, content and position.

Every unit that is not the earliest of its kind goes. ``least_run`` is an option for corpora whose short repeated lines
are to stay ("Yes." or a date line are in many good texts): with it only runs of found units go, with nothing but white
space between, of so many bytes or more, and documents in which every unit was found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.cutting import cut_spans
from firnline.llm.storage import Scratch
from firnline.llm.textblocks import ALNUM, LETTERS, LOWER, SPACE, blocks, keyed_prefix, keyed_spans, random_base, word_spans

#: Units of fewer words are never removed; one word means that every unit counts.
LINE_WORDS, SENTENCE_WORDS = 1, 1
def units_of(data: np.ndarray, offsets: np.ndarray, bases: tuple[int, int, int, int], line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> dict[str, np.ndarray]:
    """row, a, b (bytes of the row), h1, h2 of each line and sentence with words enough; a line has its line feed.

    ``bases`` are those of words and of sequences of words, for each of the two hashes.
    """
    n = len(data)
    lowered = LOWER[data]
    starts, ends, _ = word_spans(lowered, offsets, ALNUM)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    head[1:] |= data == 0x0A
    lines = np.flatnonzero(head[:n])
    bare = np.diff(np.searchsorted(starts, np.append(lines, n))) == 0  # lines without words
    if bare.any():
        more, till, _ = word_spans(data, offsets, ~SPACE)
        own = bare[np.searchsorted(lines, more, side="right") - 1]
        order = np.argsort(starts := np.append(starts, more[own]), kind="stable")
        starts, ends = starts[order], np.append(ends, till[own])[order]
    words = [keyed_prefix(keyed_spans(keyed_prefix(LETTERS[lowered], letter), starts, ends, letter), word) for letter, word in zip(bases[::2], bases[1::2], strict=True)]
    stop = np.zeros(n, bool)  # a sentence ends at the space after . ! or ?
    stop[1:] = np.isin(data[:-1], list(b".!?")) & (data[1:] == 0x20)
    inner = head.copy()
    inner[1:] |= stop
    sentences = np.flatnonzero(inner[:n])
    out = {c: [] for c in ("row", "a", "b", "h1", "h2")}
    for heads, least, level in ((lines, line_words, 0), (sentences, sentence_words, 1)):
        if not len(heads):
            continue
        tails = np.append(heads[1:], n)
        lo, hi = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
        good = hi - lo >= least
        if level:  # a line of one sentence is known as a line
            good &= ~(head[heads] & head[tails]) & ~bare[np.searchsorted(lines, heads, side="right") - 1]
        heads, tails, lo, hi = heads[good], tails[good], lo[good], hi[good]
        rows = np.searchsorted(offsets, heads, side="right") - 1
        for c, v in zip(out, (rows, heads - offsets[rows], tails - offsets[rows], *(keyed_spans(sums, lo, hi, word) for sums, word in zip(words, bases[1::2], strict=True))), strict=True):
            out[c].append(v)
    return {c: np.concatenate(v) if v else np.zeros(0, np.uint64 if c[0] == "h" else np.int64) for c, v in out.items()}


def repeated_units(docs: DataFrame, scratch: Scratch, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """doc_id, content, spans of the units that are not the earliest of their kind. docs: doc_id, content, text."""

    bases = tuple(random_base() for _ in range(4))

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(2)):
                u = units_of(data, offsets, bases, line_words, sentence_words)
                rows = pa.array(u["row"] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(u[c].astype(np.int32)) for c in "ab"], *[pa.array(u[c].view(np.int64)) for c in ("h1", "h2")]], ["doc_id", "content", "a", "b", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    units = scratch.put(docs.select("doc_id", "content", "text").mapInArrow(run, f"doc_id {kind}, content long, a int, b int, h1 long, h2 long"), "units")
    place = F.struct("doc_id", "content", "a")
    first = scratch.put(units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")  # a table: Spark splits the join where one line is very common
    later = units.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "content").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeated_units(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS, least_run: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_found, removed (array of a and b: bytes of the original text), kept (binary) for every row.

    n_found counts the bytes in repeated units whatever the length of their runs. A null text is empty. Rows equal in
    doc_id and text are one document: they keep and lose the same units. Null doc_ids rank first. Long texts are taken
    whole, other columns are not read, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text")).alias("content"), "text")
    return cut_spans(keyed, repeated_units(keyed, scratch, line_words, sentence_words), least_run)


def line_report(docs: DataFrame, least_run: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_found, n_removed, n_spans, removed, kept_sha256, text (what is kept)."""
    out = remove_repeated_units(docs, least_run=least_run)
    return out.select("doc_id", "n_bytes", "n_found", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "removed", F.sha2("kept", 256).alias("kept_sha256"), F.decode("kept", "UTF-8").alias("text"))
