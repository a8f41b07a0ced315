"""Quality rules from repetition: characters inside repeated n-grams and repeated lines.

Words and lines are hashed by a rolling hash over the bytes of a block of documents, modulo a prime and with a base that
each process draws for itself, so that no text can be written to collide; n-gram hashes combine word hashes. Hashes are
compared within a document only. An n-gram that occurs twice in a document contains a shorter one that does, so each length looks only at
places where the shorter length repeats. All of it is numpy over blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from firnline.llm.textblocks import BASE, LETTERS, SPACE, blocks, keyed_prefix, keyed_spans, mixed, random_base, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: The largest share of a document's word characters that may lie in repeated n-grams (by n) or in
#: repeated lines, as published for web-scale corpora.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 50

_KEY = random_base()

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its row has its key elsewhere, and whether it had it before."""
    both = mixed(keys ^ (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = both[order[1:]] == both[order[:-1]]
    twice, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], again[order] = same[:-1] | same[1:], same[:-1]
    return twice, again


def _sums(rows: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, values, minlength=n).astype(np.int64)


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in an n-gram that starts at one of ``at``."""
    step = np.zeros(words + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns and ``top_share`` (the largest measure as a share of its limit) of a block's documents."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, ~SPACE)
    prefix = keyed_prefix(LETTERS[data], _KEY)
    keys = keyed_spans(prefix, starts, ends, _KEY)
    points = np.zeros(len(data) + 1, np.int64)  # code points begin at bytes that do not continue one
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = _sums(rows, n, chars)
    out = {"n_words": _sums(rows, n), "word_chars": word_chars}
    signs = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = _sums(np.searchsorted(offsets, signs, side="right") - 1, n)

    words = len(starts)
    shares = np.zeros(n)
    whole = np.maximum(word_chars, 1)
    at = np.arange(max(words - 2, 0))
    at = at[rows[at] == rows[at + 2]] if len(at) else at
    grams = lambda size, at: sum((mixed(keys[at + j] + np.uint64(j)) * np.uint64(2 * j + 3) for j in range(size)), np.zeros(len(at), np.uint64))
    twice, _ = _repeated(rows[at], grams(3, at))
    at = at[twice]
    in_three = _covered(at, 3, words)
    out["n_repeat_words"] = _sums(rows[in_three], n)
    for size, limit in NGRAM_LIMITS.items():
        at = at[at + size <= words]
        at = at[rows[at] == rows[at + size - 1]]
        twice, again = _repeated(rows[at], grams(size, at))
        later = _covered(at[again], size, words)  # the first occurrence is not a repetition
        shares = np.maximum(shares, _sums(rows[later], n, chars[later]) / whole / limit)
        at = at[twice]

    breaks = np.flatnonzero(data == 0x0A)
    heads = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    heads = heads[heads < len(data)]
    line_rows = np.searchsorted(offsets, heads, side="right") - 1
    stops = np.concatenate([heads[1:], [len(data)]]) if len(heads) else heads
    stops = np.minimum(stops, offsets[line_rows + 1])
    stops = np.where((stops > heads) & (data[np.maximum(stops - 1, 0)] == 0x0A), stops - 1, stops)
    line_of = np.searchsorted(heads, starts, side="right") - 1
    line_chars = np.bincount(line_of, chars, minlength=len(heads)).astype(np.int64)
    worded = np.flatnonzero(line_chars > 0)
    _, again = _repeated(line_rows[worded], keyed_spans(prefix, heads[worded], stops[worded], _KEY))
    repeats = worded[again]
    out["n_dup_lines"] = _sums(line_rows[repeats], n)
    out["top_share"] = np.maximum(shares, _sums(line_rows[repeats], n, line_chars[repeats]) / whole / LINE_LIMIT)
    return out


def judge(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, top_share for every row.

    A null or empty text has no words and fails. Repeated rows get equal results; very long texts make blocks of
    their own; columns other than doc_id and text are ignored.
    """

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                m = measure_block(data, offsets)
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["top_share"] <= 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *[pa.array(m[c]) for c in COLUMNS], pa.array(failed), pa.array(kept), pa.array(m["top_share"])], ["doc_id", *COLUMNS, "base_failed", "kept", "top_share"])

    kinds = ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}, base_failed boolean, kept boolean, top_share double")
