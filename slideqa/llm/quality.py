"""Quality rules from a tokeniser's fertility.

A public vocabulary with byte fallback encodes every word of a text. Text like what the vocabulary was
made from takes long tokens, hardly any single bytes and spreads over many ids; noise does not. Measured
per text: characters per token, share of byte-fallback tokens, and the entropy of its token ids against
what a text of as many tokens has. A text is kept if it passes the base rules and lies in the bands of its
language, or of its script where the language is unknown. Entropy is judged from ``MIN_TOKENS`` on.

Everything is one pass without a shuffle; a worker remembers the tokens of words in a table of bounded size.

Defined results: null and empty texts have no words and fail the base rules. Rows are judged one by one,
so repeated rows give repeated results; an empty table gives no rows; texts are measured whole. Columns of the same
names as the measures are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import table
from slideqa.llm.text import SPACED, Words, flat, lean, slices, windows, words
from slideqa.llm.word_cache import WordCache, ranges


class Band(NamedTuple):
    least_chars: float
    most_chars: float
    most_bytes: float
    #: Expected bits of entropy over x = log2(tokens): a*x*x + b*x + c.
    entropy: tuple[float, float, float]


#: Characters per token, byte-fallback share and entropy. The curves of the four languages were fitted by
#: ``fitted_curves`` to documents labelled as good that pass the base rules, those whose crc32(doc_id as text) mod 4 is
#: not 2; the others tell how well they do. A text may fall short by MARGIN + SPREAD / sqrt(tokens) bits. Scripts, for unknown languages, have wide bands. Bands hold for VOCABULARY;
#: another one needs bands fitted with it.
BANDS: dict[str, Band] = {
    "en": Band(1.3, 7.0, 0.10, (-0.041, 0.984, 1.003)),
    "de": Band(1.3, 7.0, 0.10, (-0.036, 0.872, 1.511)),
    "fr": Band(1.3, 7.0, 0.10, (-0.033, 0.788, 1.903)),
    "es": Band(1.3, 7.0, 0.10, (-0.037, 0.888, 1.424)),
    "latin": Band(1.2, 8.0, 0.20, (-0.049, 1.124, -0.7)),
    "cyrillic": Band(1.0, 8.0, 0.20, (-0.049, 1.124, -0.7)),
    "other": Band(0.3, 8.0, 1.0, (-0.049, 1.124, -2.0)),
}
MIN_TOKENS = 60
MARGIN, SPREAD = 0.28, 3.2
MIN_WORDS, MAX_REPEAT = 10, 20
WINDOW = 5
#: Words that a worker remembers: later stages share its memory.
REMEMBERED = 400_000
VOCABULARY = "piece_bpe_32k.model"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, entropy double, band string, kept boolean"
_SPACE = " \t\n\r\x0b\x0c"


@cache
def _encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """Words to ids by a sentencepiece model or a tiktoken rank file, and which ids stand for a byte of a character
    that the vocabulary lacks."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("quality", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        single = np.zeros(max(ranks.values()) + 1, bool)
        single[[i for token, i in ranks.items() if len(token) == 1 and token[0] >= 0x80]] = True
        return lambda found: coder.encode_ordinary_batch(found, num_threads=1), single
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return lambda found: model.encode(found, num_threads=1), single


@cache
def _remembered(path: str) -> WordCache:
    return WordCache(lambda found: _encoder(path)[0]([w.decode() for w in found]), np.uint16, REMEMBERED)


def text_tokens(data: np.ndarray, w: Words, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of every word of every text, and the text of each."""
    pool, sizes, which = _remembered(path).tokens(data, w)
    starts = np.cumsum(sizes) - sizes
    sizes, starts = sizes[which], starts[which]
    return pool[ranges(starts, sizes)], np.repeat(w.doc, sizes)


def entropies(ids: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Bits of entropy of each text's token ids; 0 for a text without tokens."""
    keys, counts = np.unique(docs.astype(np.int64) << 20 | ids, return_counts=True)
    doc = keys >> 20
    n = np.bincount(doc, counts, n_docs)
    return np.maximum(0, np.log2(np.maximum(n, 1)) - np.bincount(doc, counts * np.log2(counts), n_docs) / np.maximum(n, 1))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more in the sequence."""
    grams = windows(hashes, WINDOW)
    if len(grams) < 2:
        return 0
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """By most letters: latin, cyrillic or other."""
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    latin = np.count_nonzero(((letters >= 65) & (letters <= 90)) | ((letters >= 97) & (letters <= 122)) | ((letters >= 0xC0) & (letters <= 0x24F)))
    cyrillic = np.count_nonzero((letters >= 0x400) & (letters <= 0x52F))
    rest = np.count_nonzero(letters >= 0x530)
    return "latin" if latin >= max(cyrillic, rest) else "cyrillic" if cyrillic >= rest else "other"


def expected_entropy(n_tokens: int, curve: tuple[float, float, float]) -> float:
    """The curve over log2(n_tokens), level beyond its highest point."""
    a, b, c = curve
    x = min(np.log2(max(1, n_tokens)), -b / (2 * a) if a < 0 else np.inf)
    return float(a * x * x + b * x + c)


def in_band(band: Band, n_tokens: int, chars: float, share: float, entropy: float) -> bool:
    if not (band.least_chars <= chars <= band.most_chars and share <= band.most_bytes):
        return False
    margin = MARGIN + SPREAD / max(1, n_tokens) ** 0.5
    return n_tokens < MIN_TOKENS or entropy >= expected_entropy(n_tokens, band.entropy) - margin


def _judged(path: str, bands: dict[str, Band]):
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_docs = part.num_rows
                data, offsets = flat(part.column(1))
                raw = data.tobytes()
                w = words(data, offsets, SPACED, lower=False, keyed=True)
                bounds = np.searchsorted(w.doc, np.arange(n_docs + 1))
                sums = np.zeros(len(data) + 1, np.int64)
                np.cumsum(((data & 0xC0) != 0x80) & SPACED[data], out=sums[1:])
                chars = sums[offsets[1:]] - sums[offsets[:-1]]
                np.cumsum(_SYMBOL[data], out=sums[1:])
                symbols = sums[offsets[1:]] - sums[offsets[:-1]]
                ids, docs = text_tokens(data, w, path)
                tokens = np.bincount(docs, minlength=n_docs)
                in_bytes = np.bincount(docs, _encoder(path)[1][ids], n_docs)
                per_token, share = chars / np.maximum(1, tokens), in_bytes / np.maximum(1, tokens)
                entropy = entropies(ids, docs, n_docs)
                langs = part.column(2).to_pylist()
                out = []
                for i in range(n_docs):
                    text = raw[offsets[i] : offsets[i + 1]].decode()
                    n = int(bounds[i + 1] - bounds[i])
                    repeats = repeated_words(w.hash[bounds[i] : bounds[i + 1]])
                    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
                    band = langs[i] if langs[i] in bands else script(text)
                    measures = int(tokens[i]), float(per_token[i]), float(share[i]), float(entropy[i])
                    kept = not failed and in_band(bands[band], *measures)
                    out.append((n, int(chars[i]), int(symbols[i]), duplicate_lines(text), repeats, failed, *measures, band, kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *names])

    return run


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", path: str | None = None, bands: dict | None = None) -> DataFrame:
    """doc_id and the measures, base_failed and kept: a row per row of docs."""
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else docs[text_col].substr(1, 0)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInArrow(lean(_judged(path or vocabulary_path(), bands or BANDS)), f"doc_id long, {FIELDS}")


def fitted_curves(labelled: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The entropy curve of each language by least squares. labelled: lang, n_tokens, entropy of documents labelled
    as good. Spark adds up the normal equations, nine sums a language; languages of fewer than three lengths are
    left out."""
    x = F.log2(F.col("n_tokens").cast("double"))
    rows = labelled.where(F.col("n_tokens") >= MIN_TOKENS).withColumn("x", x)
    sums = [F.sum(F.pow("x", F.lit(k))).alias(f"x{k}") for k in range(5)] + [F.sum(F.col("entropy") * F.pow("x", F.lit(k))).alias(f"y{k}") for k in range(3)]
    out = {}
    for r in rows.groupBy("lang").agg(F.count_distinct("n_tokens").alias("lengths"), *sums).where("lengths >= 3").collect():
        a = np.array([[r[f"x{i + j}"] for j in (2, 1, 0)] for i in (2, 1, 0)])
        out[r.lang] = tuple(np.linalg.solve(a, [r.y2, r.y1, r.y0]).tolist())
    return out


def band_report(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: of documents that pass the base rules, how many are labelled good and bad, and the shares of either
    that the bands reject. rows: doc_id, base_failed, kept; labels: doc_id, quality (1 is good)."""
    both = rows.where("not base_failed").join(labels, "doc_id")
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    lost, caught = F.count_if((F.col("quality") == 1) & ~F.col("kept")), F.count_if((F.col("quality") == 0) & ~F.col("kept"))
    return both.agg(good.alias("good"), bad.alias("bad"), F.try_divide(lost, good).alias("good_rejected"), F.try_divide(caught, bad).alias("bad_rejected"))


def _filtered(path: str, bands: dict, at: tuple[int, int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _judged(path, bands)
        for batch in batches:
            three = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at[0]).cast(pa.string()), pa.nulls(batch.num_rows, pa.string()) if at[1] is None else batch.column(at[1]).cast(pa.string())], ["doc_id", "text", "lang"])
            row = 0
            for got in measure(iter([three])):
                keep = got.column(got.schema.get_field_index("kept"))
                yield batch.slice(row, got.num_rows).filter(keep)
                row += got.num_rows

    return run


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None, bands: dict | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Without a language column scripts decide."""
    at = (docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None)
    return docs.mapInArrow(lean(_filtered(path or vocabulary_path(), bands or BANDS, at)), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
