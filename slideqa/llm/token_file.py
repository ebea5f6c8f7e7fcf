"""Token-id files of directly addressable codes.

Documents in ascending order are packed into blocks of about BLOCK ids. A block splits every id into chunks
of 8 bits: level 0 has the low chunk of each id and a bitmap of which ids continue, level 1 the next chunk
of those and a bitmap, and so on. A rank directory holds the set bits before every 512 of a bitmap, so the
place of an id's next chunk is a directory entry and a few popcounts: any id is read without decoding others.

File format: blocks one after another, each followed by one newline byte. A block is, little-endian,
magic `DACB`, its byte length after the first 8 bytes (u32), shard (u32), ids before it in the shard (u64), documents (u32),
ids (u32), levels (u32); doc_ids (i64 each), a null bitmap of doc_ids (bytes), ids per document (u32 each);
per level the number of chunks (u32), the chunks, the bitmap (bytes, low bit first) and the directory
(u32 per 512 bits). Shards are in doc_id order. Blocks are written by Spark's text sink, so a failed task
leaves nothing behind, and files are cut by a fixed number of blocks, so each is read in one task.

Defined results: null counts as empty, so a document has its end id at least; equal doc_ids are ordered by
the hash of their text, null doc_ids come first; rows stay rows. An empty table gives no rows; a text of any length
is one run of ids in one block. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, new_path, remove, table
from slideqa.llm.text import SPACED, flat, lean, slices, words
from slideqa.llm.word_cache import WordCache, ranges

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 1 << 18
BLOCKS_PER_FILE = 32
MAGIC = b"DACB"
_HEAD = struct.Struct("<4sIIQIII")
STRIDE = 512


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Words of Latin letters and printed ASCII; in these lower() and the pre-tokeniser's classes are plain.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ɏ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-zß-öø-ɏ0-9]+|\n")
_END = "</w>"


class WordCoder:
    """Encodes distinct words with the tokenizers library. Plain words are lower-cased and cut into
    pre-tokens here; the library then encodes the distinct pre-tokens of many words in few calls, each
    giving one token with the word-end mark. All other words are given to it as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path) as f:
            parts = json.load(f)
        parts |= {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
        parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.pieces = Tokenizer.from_str(json.dumps(parts))
        self.ends = np.zeros(max(self.whole.get_vocab().values()) + 1, bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith(_END)

    def __call__(self, found: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in found]
        plain = [i for i, t in enumerate(texts) if "<|" not in t and _PLAIN.fullmatch(t)]
        out: list = [None] * len(texts)
        cut = _PIECES.findall("\n".join(texts[i] for i in plain).lower())
        ids = self._piece_ids({p for p in cut if p != "\n"})
        if ids is not None:
            at, own = 0, []
            for p in [*cut, "\n"] if plain else ():
                if p == "\n":
                    out[plain[at]] = own
                    at, own = at + 1, []
                else:
                    own = own + ids[p] if own else ids[p]
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 10_000):
            part = rest[k : k + 10_000]
            for i, e in zip(part, self.whole.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _piece_ids(self, pieces: set[str]) -> dict[str, list[int]] | None:
        """None if a piece doesn't end in just one end mark; the caller then gives up on pieces."""
        every = list(pieces)
        groups = [every[k : k + 2000] for k in range(0, len(every), 2000)]
        out = {}
        for group, e in zip(groups, self.pieces.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(group) or stops[-1] != len(ids):
                return None
            start = 0
            for p, stop in zip(group, stops, strict=True):
                out[p] = ids[start:stop]
                start = stop
        return out


@cache
def _remembered(path: str) -> WordCache:
    return WordCache(WordCoder(path), np.uint16)


def text_ids(texts: pa.Array, path: str, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, one after another; and how many each has. The vocabulary
    drops white space, so words between ASCII white space are encoded on their own."""
    data, offsets = flat(texts)
    w = words(data, offsets, SPACED, lower=False)
    pool, sizes, which = _remembered(path).tokens(data, w)
    n = len(offsets) - 1
    # the end id is one more word behind the words of each text
    at = np.searchsorted(w.doc, np.arange(n), "right")
    which, docs = np.insert(which.astype(np.int64), at, len(sizes)), np.insert(w.doc, at, np.arange(n))
    pool, sizes = np.append(pool, np.uint16(end)), np.append(sizes, 1)
    starts = np.cumsum(sizes) - sizes
    return pool[ranges(starts[which], sizes[which])], np.bincount(docs, sizes[which], n).astype(np.int64)


def packed(ids: np.ndarray) -> bytes:
    """Levels of chunks, continuation bitmaps and rank directories."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(1, len(more)) // STRIDE) * STRIDE, bool)
        padded[: len(more)] = more
        before = padded.reshape(-1, STRIDE).sum(axis=1)
        directory = (np.cumsum(before) - before).astype("<u4")
        out.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return struct.pack("<I", len(out)) + b"".join(out)


def block(shard: int, before: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    levels = packed(ids)
    body = names + counts.astype("<u4").tobytes() + levels[4:]
    head = _HEAD.pack(MAGIC, _HEAD.size - 8 + len(body), shard, before, len(doc_ids), len(ids), struct.unpack("<I", levels[:4])[0])
    return head + body


class Block:
    """A block that is read in place."""

    def __init__(self, data: memoryview):
        magic, size, self.shard, self.before, n, self.n_ids, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.size, at = size + 8, _HEAD.size
        names = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), bitorder="little")[:n]
        at += -(-n // 8)
        self.doc_ids = [None if z else d for d, z in zip(names.tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(data, "<u4", n, at).astype(np.int64)
        at += 4 * n
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<I", data, at)
            chunks = np.frombuffer(data, np.uint8, m, at + 4)
            at += 4 + m
            bits = np.frombuffer(data, np.uint8, -(-m // 8), at)
            at += -(-m // 8)
            directory = np.frombuffer(data, "<u4", -(-max(1, m) // STRIDE), at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before position i."""
        _, bits, directory = self.levels[level]
        k = i // STRIDE
        out = int(directory[k]) if k < len(directory) else 0
        part = np.unpackbits(bits[k * STRIDE // 8 : -(-i // 8)], bitorder="little")
        return out + int(part[: i - k * STRIDE].sum())

    def token(self, i: int) -> int:
        """The i-th id of the block, without decoding others."""
        out, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids of positions start to end, from their own chunks alone."""
        out = np.zeros(end - start, np.uint32)
        places = np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            places = places[more]
            if not len(places):
                break
            start = self.rank(level, start)
            end = start + len(places)
        return out


def blocks(data: bytes) -> Iterator[Block]:
    view, at = memoryview(data), 0
    while at < len(view):
        one = Block(view[at:])
        yield one
        at += one.size + 1


def _packed(path: str, end: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, doc_ids, counts, ids = 0, 0, [], [], []
        waiting = 0

        def full() -> pa.RecordBatch:
            nonlocal before, waiting
            data = block(shard, before, doc_ids, np.array(counts), np.concatenate(ids))
            before, waiting = before + waiting, 0
            doc_ids.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        for batch in batches:
            for part in slices(batch):
                shard = part.column(2)[0].as_py()
                every, sizes = text_ids(part.column(1), path, end)
                at = 0
                for d, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                    if waiting and waiting + n > limit:
                        yield full()
                    doc_ids.append(d)
                    counts.append(n)
                    ids.append(every[at : at + n])
                    at, waiting = at + n, waiting + n
        if doc_ids:
            yield full()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            for one in blocks(content.as_buffer().to_pybytes()):
                ends = np.cumsum(one.counts)
                sums = [zlib.crc32(one.tokens(e - n, e).astype("<u4").tobytes()) for e, n in zip(ends.tolist(), one.counts.tolist(), strict=True)]
                n = len(one.doc_ids)
                columns = [pa.array(one.doc_ids, pa.int64()), pa.array([one.shard] * n, pa.int32()), pa.array(one.before + ends - one.counts), pa.array(one.counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each block, from its head alone."""
    for batch in batches:
        for content in batch.column(0):
            view, at, found = memoryview(content.as_buffer()), 0, []
            while at < len(view):
                _, size, shard, _, _, n, _ = _HEAD.unpack_from(view, at)
                found.append((shard, n))
                at += size + 8 + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int32(), pa.int64()))], ["shard", "n"])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END_ID, block_ids: int = BLOCK) -> None:
    """Writes the ids of all documents to files under path, in ascending doc_id order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    dealt = rows.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    data = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(lean(_packed(vocabulary or vocabulary_path(), end, block_ids)), "block binary")
    data.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of the files under path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(lean(_read), "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long")
    # one row for each shard, so the running sum over shards is short however many ids there are; heads suffice
    sizes = files.mapInArrow(lean(_sizes), "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    firsts = sizes.selectExpr("shard", "sum(n) over (order by shard) - n as first")
    return rows.join(F.broadcast(firsts), "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    found = Saved(read_tokens(spark, path), "token-rows")
    remove(spark, path)
    return found.df
