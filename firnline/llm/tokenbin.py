"""Token ids in files of independent zstandard frames with a trailing seek table.

File: frames, one after another, then the table. A frame decompresses to ids as little-endian unsigned 32-bit
integers of whole documents. The table is little-endian: for each frame its compressed length (u32), its raw
length (u64), its first document (u64, counted in the file) and the crc32 of its raw bytes (u32); for each document
its doc_id (i64) and its number of ids (u32); then the counts of frames, documents and leading documents without a
doc_id (u64 each), the crc32 of all before it in the table (u32) and the mark ``FTB1``. A reader takes the table from the end and decompresses only the frames it needs.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.storage import Scratch
from firnline.llm.textblocks import BLOCK_BYTES, LOWER, blocks, word_spans

MARK = b"FTB1"
FRAME = np.dtype([("packed", "<u4"), ("raw", "<u8"), ("first", "<u8"), ("crc", "<u4")])
HEAD = struct.Struct("<QQQ")
TAIL = struct.Struct("<QQQI4s")
FRAME_BYTES = 1 << 18
END_ID = 1
#: Pieces in each of the two generations that an encoder remembers (about 150 bytes each).
CACHE_PIECES = 300_000
#: Bytes of text in a file, about, where that makes more files than the session has shuffle partitions.
FILE_BYTES = 1 << 28


class Encoder:
    """Ids of the texts of a column under a tokenizer file, each text encoded in one piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of rows in order: their ids, and the offsets of the rows in them. A null text is empty."""
        for at in range(0, len(column), 64):
            found = self.tokenizer.encode_batch(column.slice(at, 64).fill_null("").to_pylist(), add_special_tokens=False)
            ids = [np.array(x.ids, np.uint32) for x in found]
            yield np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


# The settings of a tokenizer file under which ``WordEncoder`` is right.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

GAP, LETTER, DIGIT, SIGN, ODD, WHOLE = range(6)
#: What a byte is: ASCII letters, digits and signs, the two white spaces at which texts are cut, and the rest.
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[0x20, 0x0A]] = GAP
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[ord("'")] = ODD
#: Byte-level vocabularies write printable Latin-1 as itself and the other bytes, in order, from U+0100 on.
LETTERS_OF_BYTES = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class WordEncoder(Encoder):
    """The same ids by way of the distinct pieces of a block.

    Under ``NORMALIZERS``, ``SPLIT`` and ``BYTES`` nothing joins across white space, and a word of ASCII and of the
    Latin-1 letters (which are composed, and lower-cased one by one) falls into runs of letters, single digits and
    runs of signs. Each distinct run goes to the tokenizer's model once; words with anything else in them, with an
    apostrophe or with the beginning of a special token go to the whole tokenizer. Two generations of pieces are
    remembered, so that the memory is bounded and frequent ones stay.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.model, self.young, self.old = self.tokenizer.model, {}, {}

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        return (s["normalizer"] or {}).get("normalizers") == NORMALIZERS and (s["pre_tokenizer"] or {}).get("pretokenizers") == [SPLIT, BYTES] and s["post_processor"] is None and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in s["added_tokens"])

    def _ids(self, pieces: list[bytes], odd: np.ndarray) -> list[bytes]:
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        young, old, rest = self.young, self.old, []
        found = list(map(young.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            piece = pieces[i]
            if piece in old:
                found[i] = young[piece] = old[piece]
            elif odd[i]:
                rest.append(i)
            else:
                ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(LETTERS_OF_BYTES))]
                found[i] = young[piece] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(rest), 1 << 14):
            some = rest[at : at + (1 << 14)]
            for i, x in zip(some, self.tokenizer.encode_batch([pieces[i].decode() for i in some], add_special_tokens=False), strict=True):
                found[i] = young[pieces[i]] = struct.pack(f"<{len(x.ids)}I", *x.ids)
        return found

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, data, offsets in blocks(column, 2 * BLOCK_BYTES):
            kind, text = KIND[data], LOWER[data]
            second = np.zeros(len(data), bool)  # of a two-byte letter U+00C0 to U+00FF
            second[1:] = data[:-1] == 0xC3
            second &= (data != 0x97) & (data != 0xB7)
            kind[second] = LETTER
            kind[:-1][second[1:]] = LETTER
            text[second & (data < 0x9F)] += 0x20
            starts, ends, _ = word_spans(data, offsets, KIND != GAP)
            bad = kind == ODD
            bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
            upto = np.concatenate([[0], np.cumsum(bad)])
            whole = upto[ends] > upto[starts]
            step = np.zeros(len(data) + 1, np.int8)
            step[starts[whole]] += 1
            step[ends[whole]] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8) > 0
            kind[inside], text[inside] = WHOLE, data[inside]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            edge = edge[:-1] | (kind == DIGIT)
            edge[1:] |= kind[1:] != kind[:-1]
            heads = np.flatnonzero(edge & (kind != GAP))
            kept = kind != GAP
            place = np.cumsum(kept, dtype=np.int32)
            cuts = np.append(place[heads] - 1, place[-1] if len(place) else 0).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts), pa.py_buffer(text[kept])]).dictionary_encode()
            codes = coded.indices.to_numpy()
            odd = np.zeros(len(coded.dictionary), bool)
            odd[codes[kind[heads] == WHOLE]] = True
            found = self._ids(coded.dictionary.to_pylist(), odd)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids, before = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
            each = sizes[codes]
            upto = np.concatenate([[0], np.cumsum(each)])
            yield ids[np.arange(upto[-1]) + np.repeat(before[codes] - upto[:-1], each)], upto[np.searchsorted(heads, offsets)]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file; kept by the worker, so that later tasks find the pieces of earlier ones."""
    return WordEncoder(path) if WordEncoder.fits(path) else Encoder(path)


class Writer:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.limit, self.pack = out, frame_bytes, zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple] = []
        self.counts: list[int] = []
        self.keys: list[int | None] = []
        self.held: list[bytes] = []
        self.size = self.first = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.held.append(ids)
        self.counts.append(len(ids) // 4)
        self.size += len(ids)
        if self.size >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), self.first, zlib.crc32(raw)))
            self.held, self.size, self.first = [], 0, len(self.counts)

    def close(self) -> None:
        self._flush()
        nulls = sum(k is None for k in self.keys)
        table = np.array(self.frames, FRAME).tobytes() + np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        head = HEAD.pack(len(self.frames), len(self.counts), nulls)
        self.out.write(table + head + struct.pack("<I4s", zlib.crc32(table + head), MARK))


class Reader:
    """Documents of a file by number; ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(size - TAIL.size)
        frames, docs, self.nulls, crc, mark = TAIL.unpack(source.read(TAIL.size))
        length = frames * FRAME.itemsize + 12 * docs
        if mark != MARK or length > size - TAIL.size:
            raise ValueError("not a whole token file")
        source.seek(size - TAIL.size - length)
        table = source.read(length)
        if zlib.crc32(table + HEAD.pack(frames, docs, self.nulls)) != crc:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(table, FRAME, frames)
        self.keys = np.frombuffer(table, "<i8", docs, frames * FRAME.itemsize)
        self.counts = np.frombuffer(table, "<u4", docs, frames * FRAME.itemsize + 8 * docs)
        self.places = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        self.source.seek(int(self.places[k]))
        raw = self.unpack.decompress(self.source.read(int(f["packed"])), max_output_size=int(f["raw"]))
        if len(raw) != f["raw"] or zlib.crc32(raw) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """doc_id and ids of each document, a frame at a time."""
        for k in range(len(self.frames)):
            raw, at, first = self.frame(k), 0, int(self.frames["first"][k])
            stop = int(self.frames["first"][k + 1]) if k + 1 < len(self.frames) else len(self.counts)
            for i, (key, n) in enumerate(zip(self.keys[first:stop].tolist(), self.counts[first:stop].tolist(), strict=True), first):
                yield (None if i < self.nulls else key), raw[at : at + 4 * n]
                at += 4 * n

    def document(self, i: int) -> bytes:
        k = int(np.searchsorted(self.frames["first"], i, side="right")) - 1
        begin = 4 * int(self.counts[int(self.frames["first"][k]) : i].sum(dtype=np.int64))
        return self.frame(k)[begin : begin + 4 * int(self.counts[i])]


def _place(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None, frame_bytes: int = FRAME_BYTES, encoder: Callable[[str], Encoder] = encoder_of) -> DataFrame:
    """Writes one file per range of doc_id (integers); returns part, path, n_docs and n_ids of each file.

    Files follow ascending doc_id (nulls first), as do the rows in them; rows of one doc_id follow a hash of their
    text. A null or empty text has the end id alone; a long one is a frame of its own; other columns are not read.
    An empty table makes no files. Without ``partitions`` there are as many files as shuffle partitions, and more
    where they would hold over ``FILE_BYTES`` of text. Every attempt of a task writes under a name of its own and
    nothing is renamed: a file counts if the returned rows name it, so repeated and doubled tasks do no harm. The
    result writes files whenever it is computed.
    """

    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.ftb"
        model, end, ids, n = encoder(tokenizer), struct.pack("<I", end_id), 0, 0
        with fs.open_output_stream(f"{base}/{name}") as out:
            writer = Writer(out, frame_bytes)
            for batch in batches:
                keys, at = batch.column(0).to_pylist(), 0
                for found, cuts in model.encode(batch.column(1)):
                    raw, places = found.astype("<u4").tobytes(), (4 * cuts).tolist()
                    for key, a, b in zip(keys[at : at + len(places) - 1], places, places[1:], strict=False):
                        writer.add(key, raw[a:b] + end)
                    at, ids = at + len(places) - 1, ids + len(found) + len(places) - 1
                n += batch.num_rows
            writer.close()
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([ids], pa.int64())})
        else:
            fs.delete_file(f"{base}/{name}")

    n = partitions
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text").mapInArrow(run, "part int, path string, n_docs long, n_ids long")


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start and ids (binary) of every document, from path and base (ids in the files before it)."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                fs, path = _place(uri)
                with fs.open_input_file(path) as source:
                    held, size = [], 0
                    for key, ids in Reader(source, source.size()).documents():
                        held.append({"doc_id": key, "start": start, "ids": ids})
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 8 * FRAME_BYTES:
                            yield pa.RecordBatch.from_pylist(held, OUT)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, OUT)

    return files.select("path", "base").mapInArrow(run, "doc_id long, start long, ids binary")


def tokenize_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from files that are written and read back.

    Nulls, empty and long texts, repeated rows and other columns are as in ``write_token_files``; repeated rows each
    have their own ids, and an empty table gives no rows. The files stay in the shared folder. One row per file (a partition of the write) is summed to give each file
    the number of ids before it.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    files = scratch.put(write_token_files(docs, scratch.path("files"), tokenizer, **options), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")
    read = read_token_files(based.repartition(max(1, files.count()), "path"))
    return read.select("doc_id", "start", (F.octet_length("ids") / F.lit(4)).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
