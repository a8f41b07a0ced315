"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; for each of its bits a binary naive-Bayes classifier over hashed n-grams of 2 to 4
bytes, lower-cased, says how likely the bit is set. Decoding sums, per language, each bit's logistic loss weighted
by how well the bit told its two sides apart in training, and takes the least; a small lead over the runner-up
flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.textblocks import ALNUM, LOWER, blocks, mixed

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
#: Rows that the classifiers are fitted on at most (about), drawn by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Languages beyond this number would make long codewords.
MAX_LANGUAGES = 1000
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split of the languages in two for up to six, else hashed splits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.array([[(m >> i) & 1 for i in range(n)] for m in range(1, 1 << (n - 1))]).T
        return 2.0 * splits - 1
    bits = int(np.ceil(10 * np.log2(n)))
    draws = mixed(np.arange(1, n * bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
    return 2.0 * draws.reshape(n, bits).astype(float) - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram of letters and digits; runs of other bytes count as one border."""
    kept = ALNUM[data]
    firsts = np.zeros(len(data), bool)
    firsts[offsets[:-1][offsets[:-1] < len(data)]] = True
    border = ~kept
    border[1:] &= kept[:-1] | firsts[1:]
    take = kept | border | firsts
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[take]
    value = np.where(kept, LOWER[data], 0x20)[take].astype(np.uint32)
    buckets, owners = [], []
    code = value.copy()
    for size in range(2, max(SIZES) + 1):
        if len(value) < size:
            break
        code = (code[:-1] << np.uint32(8)) | value[size - 1 :]
        if size in SIZES:
            same = rows[size - 1 :] == rows[: len(code)]
            buckets.append((((code ^ np.uint32(size * 0x01000193)) * np.uint32(0x9E3779B1)) >> np.uint32(16))[same])
            owners.append(rows[: len(code)][same])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log-odds of a set bit
    strength: np.ndarray  # bits


def has_letter(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score and whether it is ambiguous, from each row's log-odds per bit."""
    loss = np.zeros((len(margins), len(model.languages)))
    for b in range(model.code.shape[1]):
        loss += model.strength[b] * np.logaddexp(0, -margins[:, b, None] * model.code[None, :, b])
    loss /= model.strength.sum()
    likely = np.exp(loss.min(axis=1, keepdims=True) - loss) if loss.size else loss
    likely = likely**2 / np.maximum((likely**2).sum(axis=1, keepdims=True), 1e-300)
    best = likely.argmax(axis=1)
    ranked = np.sort(likely, axis=1)
    lead = ranked[:, -1] - ranked[:, -2] if likely.shape[1] > 1 else np.ones(len(best))
    return best, likely[np.arange(len(best)), best], lead < AMBIGUOUS


def margins_of(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Mean log-odds per n-gram, scaled; zero for rows without n-grams."""
    n = len(offsets) - 1
    buckets, rows = features(data, offsets)
    counts = np.maximum(np.bincount(rows, minlength=n), 1)
    sums = np.stack([np.bincount(rows, model.weights[buckets, b], minlength=n) for b in range(model.code.shape[1])], axis=1)
    # n-grams overlap: as evidence a text counts as the square root of its n-grams
    return sums / counts[:, None] * np.sqrt(counts)[:, None]


def train(rows: DataFrame, limit: int = TRAIN_ROWS) -> Model | None:
    """Fits the classifiers on text and lang of at most about ``limit`` rows; None where no labelled text has an n-gram.

    A language is learned if one of its texts in the sample has an n-gram. More than ``MAX_LANGUAGES`` of them are an error.

    Tasks send n-gram counts per language, which Spark adds up: at most languages x buckets numbers, whatever the
    number of rows.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = rows.select("lang").count()
    if not n:
        return None
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, limit / n))) if n > limit else rows

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, end, data, offsets in blocks(batch.column(0)):
                buckets, owners = features(data, offsets)
                for lang in set(langs[first:end]):
                    own = (langs[first:end] == lang)[owners]
                    held[lang] = held.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(buckets[own], minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})

    counted = some.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    tables = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MAX_LANGUAGES + 1).toArrow()
    languages = sorted(tables.column("lang").to_pylist())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages in the sample")
    counts = np.zeros((len(languages), BUCKETS))
    for lang, c in zip(tables.column("lang").to_pylist(), tables.column("c"), strict=True):
        flat = c.values.flatten()
        counts[languages.index(lang), flat[0].to_numpy()] = flat[1].to_numpy()
    code = codewords(len(languages))
    shares = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)  # each language counts the same
    bits = code.shape[1]
    weights, strength = np.zeros((BUCKETS, bits)), np.ones(bits)
    for b in range(bits):
        up, down = shares[code[:, b] > 0], shares[code[:, b] < 0]
        if len(up) and len(down):
            p, q = up.mean(axis=0), down.mean(axis=0)
            weights[:, b] = np.log(p / q)
            strength[b] = np.abs(p - q).sum() / 2 + 1e-6
    return Model(tuple(languages), code, weights, strength)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row.

    A null text or one without a letter is ``und`` with score 0, as is everything without a model. Empty tables
    stay empty; repeated rows get equal results. The model (buckets x bits) is broadcast: its size depends on the
    number of languages alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            letters = has_letter(texts)
            for first, end, data, offsets in blocks(texts):
                ok = letters[first:end]
                if m is None:
                    names, score, unsure = [UNKNOWN] * (end - first), np.zeros(end - first), np.zeros(end - first, bool)
                else:
                    best, score, unsure = decode(margins_of(data, offsets, m), m)
                    names = [m.languages[k] if good else UNKNOWN for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
                    score, unsure = np.where(ok, score, 0.0), unsure & ok
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def _fold(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: fitted on the rows whose crc32(doc_id) mod 5 is not 0.

    Null and letterless texts are ``und``, as is everything where nothing could be learned; a null doc_id counts as the
    empty string in the fold; long texts are read whole; repeated rows get equal results; an empty table gives no rows.
    Other columns are not read.
    """
    held_out = _fold(F.col("doc_id"), 5) == 0
    return identify(docs, train(docs.where(~held_out))).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
