"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved again and again, leaves are encoded on their own, and halves are joined
bottom-up: a window around the join is encoded anew and grown until what it gives agrees exactly with the
left half's tokens at its start and with the right half's at its end. Texts longer than a segment have their
segments encoded in different tasks.

Why this is exact: a window edge between a printed ASCII character and ASCII white space is always a cut of
the pre-tokeniser, and what follows it doesn't depend on what precedes it. Where a text has no such place
near the join, a window edge is any token edge; then AGREE tokens must agree on either side. Inside a
pre-token a BPE result is characterised by its adjacent pairs, and sharing a token chains them.

Leaves go to tiktoken, which holds the same vocabulary and is several times faster; texts with characters
beyond Latin letters and printed ASCII go to the tokenizers library, in one piece or in leaves likewise.

Defined results: null counts as empty, and an empty text has no ids; repeated rows give repeated results; an empty
table gives an empty one; texts of any length are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import table
from slideqa.llm.text import lean, slices

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END, END_ID = "<|endoftext|>", 50256
#: Characters of a leaf; characters of a segment, which is encoded in a task of its own.
LEAF, SEGMENT = 8192, 65536
#: Bytes of the first window to either side of a join, and tokens that must agree at an edge inside a word.
FIRST, AGREE = 32, 8
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")
_CUT = re.compile(rb"(?<=[\x21-\x7e])(?=[\x20\x09\x0a\x0d])")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}  # noqa: SIM115
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END: END_ID})
        self.lengths = np.zeros(END_ID + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        self.lengths[END_ID] = len(END)

    @cached_property
    def slow(self):
        """The library's own encoder; loaded where a text needs it, as it is large."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.vocabulary)
        out.no_truncation()
        out.no_padding()
        return out

    def leaf(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        elif END in text:
            ids = self.fast.encode(text, allowed_special={END})
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        if len(text) <= leaf:
            return self.leaf(text)
        parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        return self.tree([p.encode() for p in parts], [self.leaf(p) for p in parts])

    def tree(self, parts: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
        """Joins neighbours level by level."""
        while len(parts) > 1:
            ids = [self.joined(parts[i], ids[i], parts[i + 1], ids[i + 1]) if i + 1 < len(parts) else ids[i] for i in range(0, len(parts), 2)]
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return ids[0] if ids else np.zeros(0, np.uint32)

    def joined(self, a: bytes, ids_a: np.ndarray, b: bytes, ids_b: np.ndarray) -> np.ndarray:
        """The encoding of a + b from those of a and b."""
        if not a or not b:
            return ids_b if not a else ids_a
        ends_a, ends_b = np.cumsum(self.lengths[ids_a]), np.cumsum(self.lengths[ids_b])
        size = FIRST
        while True:
            p, sure_p = self._left_edge(a, ends_a, size)
            q, sure_q = self._right_edge(b, ends_b, size)
            ids = self.leaf((a[p:] + b[:q]).decode())
            i = 0 if p == 0 else int(np.searchsorted(ends_a, p)) + 1
            j = int(np.searchsorted(ends_b, q)) + 1
            whole = p == 0 and q == len(b)
            if whole or self._agree(ids, ids_a[i:], 0 if p == 0 else 1 if sure_p else AGREE) and self._agree(ids[::-1], ids_b[:j][::-1], 0 if q == len(b) else 1 if sure_q else AGREE):
                return np.concatenate([ids_a[:i], ids, ids_b[j:]])
            size *= 2

    @staticmethod
    def _agree(ids: np.ndarray, other: np.ndarray, least: int) -> bool:
        return len(ids) >= 2 * least and len(other) >= least and bool((ids[:least] == other[:least]).all())

    @staticmethod
    def _left_edge(a: bytes, ends: np.ndarray, size: int) -> tuple[int, bool]:
        """A place in a, ``size`` bytes before its end or more, and whether it is a cut for certain."""
        low = max(0, len(a) - 4 * size)
        if len(a) > size:
            cuts = [m.start() for m in _CUT.finditer(a, low, len(a) - size + 1) if low < m.start() <= len(a) - size]
            edges = ends[np.searchsorted(ends, low) : np.searchsorted(ends, len(a) - size, "right")]
            known = set(edges.tolist())
            for p in reversed(cuts):
                if p in known:
                    return p, True
            for p in reversed(edges.tolist()):
                if 0 < p < len(a) and a[p] & 0xC0 != 0x80:
                    return p, False
        return 0, True

    @staticmethod
    def _right_edge(b: bytes, ends: np.ndarray, size: int) -> tuple[int, bool]:
        high = min(len(b), 4 * size)
        if len(b) > size:
            known = ends[np.searchsorted(ends, size) : np.searchsorted(ends, high, "right")].tolist()
            edges = set(known)
            for m in _CUT.finditer(b, size, min(len(b), high + 1)):
                if m.start() in edges and m.start() < len(b):
                    return m.start(), True
            for q in known:
                if q < len(b) and b[q] & 0xC0 != 0x80:
                    return q, False
        return len(b), True

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@cache
def coder(vocabulary: str, ranks: str) -> Coder:
    return Coder(vocabulary, ranks)


def _encoded(where: tuple[str, str], leaf: int, back: bool = False):
    """The text in column 1 becomes its ids, little-endian unsigned 32-bit, and what they decode to if ``back``;
    the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*where)
        for batch in batches:
            for part in slices(batch):
                ids = [c.encode(t or "", leaf) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(c, ids, back), *part.columns[2:]], ["doc_id", "ids", *["text"][: int(back)], *part.schema.names[2:]])

    return run


def _columns(c: Coder, ids: list[np.ndarray], back: bool) -> list[pa.Array]:
    out = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
    return [*out, pa.array([c.decode(x) for x in ids], pa.string())] if back else out


def _cut(size: int):
    """doc_id, key, text -> a row for each ``size`` characters of a text, which is gone through once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, key, text = (batch.column(i)[k].as_py() for i in range(3))
                for at in range(0, len(text), 16 * size):
                    parts = [text[i : i + size] for i in range(at, min(len(text), at + 16 * size), size)]
                    first = at // size
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array(parts), pa.array([key] * len(parts)), pa.array(range(first, first + len(parts)), pa.int64())], ["doc_id", "part", "key", "segment"])

    return run


def _joined(where: tuple[str, str], back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*where)
        for batch in batches:
            for k in range(batch.num_rows):
                segments = sorted(batch.column(1)[k].as_py(), key=lambda x: x["segment"])
                ids = c.tree([s["part"].encode() for s in segments], [np.frombuffer(s["ids"], "<u4") for s in segments])
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], *_columns(c, [ids], back), batch.column(2)[k : k + 1]], ["doc_id", "ids", *["text"][: int(back)], "copies"])

    return run


def _decoded(where: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*where)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [c.decode(np.frombuffer(x, "<u4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: tuple[str, str] | None = None, leaf: int = LEAF, segment: int = SEGMENT, back: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers): a row per row of docs. back: also text, what
    the ids decode to, so that a task needs one Python worker for both."""
    where = where or paths()
    text = ", text string" if back else ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > segment
    short = rows.where(~is_long).mapInArrow(lean(_encoded(where, leaf, back)), f"doc_id long, ids binary{text}")
    parts = rows.where(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text").mapInArrow(lean(_cut(segment)), "doc_id long, part string, key string, segment long")
    one = parts.groupBy("doc_id", "key", "segment", "part").agg(F.count("*").alias("copies"))
    one = one.select("doc_id", F.col("part").alias("text"), "part", "key", "segment", "copies")
    done = one.mapInArrow(lean(_encoded(where, leaf)), "doc_id long, ids binary, part string, key string, segment long, copies long")
    texts = done.groupBy("doc_id", "key").agg(F.collect_list(F.struct("segment", "part", "ids")).alias("segments"), F.max("copies").alias("copies"))
    long = texts.select("doc_id", "segments", "copies").mapInArrow(lean(_joined(where, back)), f"doc_id long, ids binary{text}, copies long")
    long = long.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copies", "copy")
    return short.unionByName(long)


def decoded(ids: DataFrame, where: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids, text: the text that the ids stand for."""
    return ids.select("doc_id", "ids").mapInArrow(lean(_decoded(where or paths())), "doc_id long, ids binary, text string")


def digests(ids: Column, text: Column) -> list[Column]:
    return [F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text.cast("binary"), 256).alias("decoded_sha256")]


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encoded(table(spark, sf_dir, "documents"), back=True)
    return both.select("doc_id", *digests(F.col("ids"), F.col("text")))
