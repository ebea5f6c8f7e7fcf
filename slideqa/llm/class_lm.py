"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

log10 P(w | v) = log10 P(class(w) | class(v)) + log10 P(w | class(w)), over lower-cased words and one end
token a text, which is also the context of the first word.

- Word counts cover all training texts. Words are held as 64-bit hashes; with ``keyed``, as the query has it, a
  digest of all training texts is their key: scores repeat on the same texts, and who doesn't know each of them can't
  make words that collide.
- Exchange rounds cluster the ``CLUSTERED`` most frequent words into CLASSES classes; meanwhile every other word
  counts as one of RARE contexts by its hash. Bigrams are counted once over all training texts and gathered into one
  row for each clustered word, which holds a number for each left and right neighbour at most. In a round every word
  finds the class that raises the likelihood of the class bigrams most,
  half of the words a round move; a round that doesn't help is undone, and fewer words move at once from then
  on. It ends when a turn of all words raises the likelihood by less than ``SHARE``. Rows are dealt to tasks; the
  driver holds the classes and the class-by-class counts.
- Then every other training word goes to the class that gains the most by the counts of the classes around it, in all
  training texts; the class counts stand still meanwhile, so words are placed apart from each other. The classes of
  all words are a table, and class bigrams are counted anew with it.
- A word that no training text has may be of any class: its probability is the sum over them, and what follows it
  goes by class frequencies.
- Texts are then coded as a class, one byte, a token: by a table of the ``LOOKUP`` most frequent words, sent to the
  tasks; every other word is joined with the table of classes and counts. Class bigrams are counted and texts are
  scored on the codes.

Defined results: null counts as empty (one end token); null doc_ids count as empty text for the training
split; repeated rows give repeated results; words of equal counts at the border of the clustered ones are taken by
their hashes; an empty table gives no rows; texts are counted and scored whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table
from slideqa.llm.text import flat, lean, slices, words

CLUSTERED, CLASSES, RARE = 8192, 48, 16
#: The class of the end token and that of words that training doesn't know.
END, UNSEEN = CLASSES, CLASSES + 1
#: A key below 256 of a class before or after a word, and how often.
AROUND = np.dtype([("key", "u1"), ("n", "<u4")])
#: Words sent to the scoring tasks: 16 bytes each.
LOOKUP = 400_000
#: Exchange ends when a turn of all words raises the likelihood by less than this share of it.
SHARE = 0.001
#: Parts that words are moved in at first, and at most: parts are halved where a move of one doesn't help.
PARTS, MOST_PARTS = 2, 8
#: The key of words that no texts' key is asked for.
PUBLIC = bytes(16)
#: Weight of class frequencies against class transitions.
PRIOR = 1.0


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def text_key(docs: DataFrame) -> bytes:
    """A key for the hashes of words: from the sums of four parts of the SHA-256 of each text, in any order of rows."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"part{i}") for i in range(4)]
    return blake2b(repr([int(x or 0) for x in docs.agg(*parts).first()]).encode(), digest_size=16).digest()


def _counter(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [words(*flat(part.column(0)), key=key).hash for part in slices(batch, 0)]
            u, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


_counted = _counter(PUBLIC)


def most_frequent(counts: DataFrame, limit: int, ties: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (ascending) and counts of all words of at least some count, ``limit`` words at most; that count. ties:
    of the words of the next count those of the smallest hashes fill the limit up."""
    tops = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(limit + 1).toArrow()
    n, sizes = tops["n"].to_numpy(), tops["words"].to_numpy()
    fit = int(np.searchsorted(np.cumsum(sizes), limit, "right"))
    least = int(n[fit - 1]) if fit else (int(n[0]) + 1 if len(n) else 1)
    got = counts.where(F.col("n") >= least).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    if ties and fit < len(sizes) and len(h) < limit:
        more = counts.where(F.col("n") == int(tops["n"][fit].as_py())).orderBy("h").limit(limit - len(h)).toArrow()
        h, n = np.concatenate([h, more["h"].to_numpy().view(np.uint64)]), np.concatenate([n, more["n"].to_numpy()])
    order = np.argsort(h)
    return h[order], n[order], least


class Vocabulary(NamedTuple):
    """Clustered words: ascending hashes, and their key. A word's number is its place, or that of its rare class."""

    hashes: np.ndarray
    key: bytes = PUBLIC

    @property
    def end(self) -> int:
        return len(self.hashes) + RARE

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + (h % np.uint64(RARE)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[at] == h
            out[found] = at[found]
        return out


def _sequence(numbers: np.ndarray, doc: np.ndarray, n_docs: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's numbers with the end number behind them; and the text of each."""
    at = np.searchsorted(doc, np.arange(n_docs), "right")
    return np.insert(numbers, at, end), np.insert(doc, at, np.arange(n_docs))


def _before(seq: np.ndarray, end: int) -> np.ndarray:
    """What stands before each number: as texts end in the end number, it also stands before their first."""
    return np.concatenate([[end], seq[:-1]])


def _bigrams(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = vocabulary.end + 1
        for batch in batches:
            keys = []
            for part in slices(batch, 0):
                w = words(*flat(part.column(0)), key=vocabulary.key)
                seq, _ = _sequence(vocabulary.numbers(w.hash), w.doc, part.num_rows, vocabulary.end)
                keys.append(_before(seq, vocabulary.end) * size + seq)
            u, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u // size), pa.array(u % size), pa.array(n.astype(np.int64))], ["v", "w", "n"])

    return run


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def class_counts(vector: np.ndarray, ids: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(classes[ids], vector, k)


def best_class(own: int, left: np.ndarray, right: np.ndarray, itself: float, m: np.ndarray, movable: int) -> tuple[int, float]:
    """The class that gains the most if a word goes there from ``own``, and the gain. left, right: counts of
    the classes before and after the word; itself: counts of the word after itself; m: class bigram counts."""
    rest = m.copy()
    rest[:, own] -= left
    rest[own, :] -= right
    rest[own, own] += itself
    l, r = left.copy(), right.copy()
    l[own] -= itself
    r[own] -= itself
    base = _phi(rest)
    column = (_phi(rest + l[:, None]) - base)[:, :movable]
    row = (_phi(rest + r[None, :]) - base)[:movable]
    b = np.arange(movable)
    gain = column.sum(axis=0) - column[b, b] + row.sum(axis=1) - row[b, b]
    gain += _phi(rest[b, b] + l[b] + r[b] + itself) - base[b, b]
    # the counts next to the word raise its neighbours' margins wherever it goes
    before, after = (rest.sum(axis=1) + l)[:movable], (rest.sum(axis=0) + r)[:movable]
    gain -= _phi(before + r.sum() + itself) - _phi(before) + _phi(after + l.sum() + itself) - _phi(after)
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def _exchange(classes: np.ndarray, m: np.ndarray, part: int, parts: int):
    """Rows (word, left ids and counts, right ids and counts) to (word, class) for the words whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            word = batch.column(0).to_numpy()
            (left, right), (left_n, right_n) = ([batch.column(i).flatten().to_numpy() for i in at] for at in ((1, 3), (2, 4)))
            of_left, of_right = (batch.column(i).offsets.to_numpy() - batch.column(i).offsets[0].as_py() for i in (1, 3))
            for i in np.flatnonzero(word % parts == part).tolist():
                w, l, r = int(word[i]), slice(of_left[i], of_left[i + 1]), slice(of_right[i], of_right[i + 1])
                before = class_counts(left_n[l], left[l], classes, len(m))
                after = class_counts(right_n[r], right[r], classes, len(m))
                to, gain = best_class(int(classes[w]), before, after, float(right_n[r][right[r] == w].sum()), m, CLASSES)
                if gain > 1e-6:
                    out.append((w, to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["word", "class"])

    return run


def _matrix(classes: np.ndarray, k: int):
    """Bigram rows (v, w, n) to the counts of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            v, w, n = (batch.column(i).to_numpy() for i in range(3))
            total += np.bincount(classes[v] * k + classes[w], n, k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    return run


def class_matrix(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    cells = bigrams.mapInArrow(_matrix(classes, k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(k, k)


def likelihood(m: np.ndarray) -> float:
    return float(_phi(m).sum() - _phi(m.sum(axis=0)).sum() - _phi(m.sum(axis=1)).sum())


def clustered(bigrams: DataFrame, order: np.ndarray, n_words: int, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes by exchange, from frequency ranks; the class bigram counts; the likelihood after each round."""
    k = CLASSES + RARE + 1
    classes = np.concatenate([np.zeros(n_words, np.int64), CLASSES + np.arange(RARE + 1)])
    classes[order] = np.arange(n_words) % CLASSES
    m = class_matrix(bigrams, classes, k)
    values = [likelihood(m)]
    ends = [F.struct(F.col("v").alias("o"), "n"), F.struct(F.col("w").alias("o"), "n")]
    left = bigrams.where(F.col("w") < n_words).groupBy(F.col("w").alias("word")).agg(F.collect_list(ends[0]).alias("l"))
    right = bigrams.where(F.col("v") < n_words).groupBy(F.col("v").alias("word")).agg(F.collect_list(ends[1]).alias("r"))
    both = left.join(right, "word").select("word", F.col("l.o").alias("left"), F.col("l.n").alias("left_n"), F.col("r.o").alias("right"), F.col("r.n").alias("right_n"))
    both = Saved(both, "neighbours")
    spread = both.df.repartition(int(bigrams.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    part, parts, rises = 0, PARTS, []
    while len(rises) < parts or sum(rises[-parts:]) > share * abs(values[-1]):
        moves = spread.mapInArrow(_exchange(classes, m, part, parts), "word long, class long").toArrow()
        new = classes.copy()
        new[moves["word"].to_numpy()] = moves["class"].to_numpy()
        tried = class_matrix(bigrams, new, k) if moves.num_rows else m
        rise = likelihood(tried) - values[-1]
        if rise > 0:
            classes, m = new, tried
        elif moves.num_rows and parts < MOST_PARTS:
            # words that moved at once were in each other's way: fewer of them move in a turn from now on
            part, parts, rises = part - 1, 2 * parts, []
        rises.append(max(0.0, rise))
        values.append(likelihood(m))
        part = (part + 1) % parts
    both.drop()
    return classes, m, values


def _contexts(vocabulary: Vocabulary, classes: np.ndarray, k: int):
    """A row for each word that isn't clustered: the classes before (key) and after it (k + key) and how often, packed
    as AROUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_clustered = len(vocabulary.hashes)
        for batch in batches:
            hashes, before, after = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in slices(batch, 0):
                w = words(*flat(part.column(0)), key=vocabulary.key)
                numbers = vocabulary.numbers(w.hash)
                seq, _ = _sequence(numbers, w.doc, part.num_rows, vocabulary.end)
                at = np.flatnonzero((seq >= n_clustered) & (seq < vocabulary.end))
                hashes.append(w.hash[numbers >= n_clustered])
                before.append(classes[_before(seq, vocabulary.end)[at]])
                after.append(k + classes[seq[at + 1]])
            u, own = np.unique(np.concatenate(hashes), return_inverse=True)
            own *= 2 * k
            cells, n = np.unique(np.concatenate([own + np.concatenate(before), own + np.concatenate(after)]), return_counts=True)
            packed = np.empty(len(cells), AROUND)
            packed["key"], packed["n"] = cells % (2 * k), n
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), _binary(packed, np.searchsorted(cells, np.arange(len(u) + 1) * (2 * k)))], ["h", "around"])

    return run


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values between each two bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def placed(around: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of the highest gain for each row of counts of classes before and after a word, at class bigrams m."""
    k = len(m)
    chance = np.log(m + 0.5)
    left, right = around[:, :k], around[:, k:]
    gain = left @ chance[:, :CLASSES] + right @ chance[:CLASSES].T
    margins = np.log(m.sum(axis=0) + 0.5 * k) + np.log(m.sum(axis=1) + 0.5 * k)
    return np.argmax(gain - left.sum(axis=1, keepdims=True) * margins[None, :CLASSES], axis=1)


def _placed(m: np.ndarray):
    """Rows of _contexts, in order of words, to each word's count and class. The last word of a batch may go on in the
    next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(m)

        def rows(h: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
            n = around[:, :k].sum(axis=1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(placed(around, m).astype(np.int64))], ["h", "n", "class"])

        open_h, open_around = np.zeros(0, np.int64), np.zeros((0, 2 * k))
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            found, each = data.view(AROUND), np.diff(offsets) // AROUND.itemsize
            new = np.concatenate([[True], h[1:] != h[:-1]])
            own = np.repeat(np.cumsum(new) - 1, each)
            names = h[new]
            around = np.bincount(own * (2 * k) + found["key"], found["n"], len(names) * 2 * k).reshape(-1, 2 * k)
            if len(open_h) and names[0] == open_h[0]:
                around[0] += open_around[0]
            elif len(open_h):
                names, around = np.concatenate([open_h, names]), np.concatenate([open_around, around])
            open_h, open_around = names[-1:], around[-1:]
            yield rows(names[:-1], around[:-1])
        if len(open_h):
            yield rows(open_h, open_around)

    return run


def _class_table(docs: DataFrame, vocabulary: Vocabulary, n: np.ndarray, classes: np.ndarray, m: np.ndarray) -> Saved:
    """h, n, class of every word of docs."""
    k = len(m)
    around = docs.mapInArrow(_contexts(vocabulary, classes, k), "h long, around binary")
    rest = around.repartition("h").sortWithinPartitions("h").mapInArrow(_placed(m), "h long, n long, class long")
    first = pa.table({"h": vocabulary.hashes.view(np.int64), "n": n.astype(np.int64), "class": classes[: len(n)]})
    return Saved(docs.sparkSession.createDataFrame(first).unionByName(rest), "classes")


class Classes(NamedTuple):
    vocabulary: Vocabulary
    of: Saved  # h, n, class of every training word
    lookup: np.ndarray  # ascending hashes
    counts: np.ndarray
    classes: np.ndarray  # of the words in lookup
    least: int  # every word of at least this count is in lookup
    likelihoods: list[float]


def _coded(known: Classes):
    """Each text as its codes: a byte a token, the end included. logs and n_known: what lookup tells of its counts;
    outside: the words that aren't there, in their order, which have the code UNSEEN until they are joined."""
    lookup, counts, classes, key = known.lookup, known.counts, known.classes.astype(np.uint8), known.vocabulary.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_docs = part.num_rows
                w = words(*flat(part.column(1)), key=key)
                codes, found, at = np.full(len(w.hash), UNSEEN, np.uint8), np.zeros(len(w.hash), bool), np.zeros(0, np.int64)
                if len(lookup):
                    at = np.minimum(np.searchsorted(lookup, w.hash), len(lookup) - 1)
                    found = lookup[at] == w.hash
                    at = at[found]
                    codes[found] = classes[at]
                seq, doc = _sequence(codes, w.doc, n_docs, END)
                every, outside = np.arange(n_docs + 1), w.doc[~found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        _binary(seq, np.searchsorted(doc, every)),
                        pa.array(np.bincount(w.doc[found], np.log10(counts[at] + 0.5), n_docs).astype(float)),  # without words bincount gives integers
                        pa.array(np.bincount(w.doc[found], minlength=n_docs)),
                        pa.ListArray.from_arrays(np.searchsorted(outside, every).astype(np.int32), w.hash[~found].view(np.int64)),
                    ],
                    ["doc_id", "codes", "logs", "n_known", "outside"],
                )

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _coded with ``more``: place among the words outside, class and count of those that training knows."""
    for batch in batches:
        n_docs = batch.num_rows
        doc_id, codes, logs, n_known, n_outside, more = batch.columns
        data, offsets = flat(codes)
        data, found = data.copy(), more.flatten()
        doc = np.repeat(np.arange(n_docs), pc.fill_null(pc.list_value_length(more), 0).to_numpy())
        n = n_outside.to_numpy()
        # the words outside of all texts of the batch, one after another
        place = (np.cumsum(n) - n)[doc] + found.field("at").to_numpy()
        data[np.flatnonzero(data == UNSEEN)[place]] = found.field("class").to_numpy()
        matched = np.bincount(doc, minlength=n_docs)
        value = np.bincount(doc, np.log10(found.field("n").to_numpy() + 0.5), n_docs) + (n - matched) * np.log10(0.5)
        yield pa.RecordBatch.from_arrays(
            [doc_id, _binary(data, offsets), pa.array(logs.to_numpy() + value), pa.array(n_known.to_numpy() + matched)], ["doc_id", "codes", "logs", "n_known"]
        )


def class_codes(docs: DataFrame, known: Classes) -> Saved:
    """doc_id, codes (the class of each token), logs (the sum of log10(count + 0.5) over words) and n_known, of docs
    (doc_id, text)."""
    seen = docs.mapInArrow(lean(_coded(known)), "doc_id long, codes binary, logs double, n_known long, outside array<long>")
    seen = Saved(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    words_ = known.of.df.where(F.col("n") < known.least).select("h", "n", F.col("class").cast("tinyint").alias("class"))
    found = seen.df.select("row", F.posexplode("outside").alias("at", "h")).join(words_, "h").groupBy("row").agg(F.collect_list(F.struct("at", "class", "n")).alias("more"))
    both = seen.df.withColumn("outside", F.size("outside").cast("long")).join(found, "row", "left").select("doc_id", "codes", "logs", "n_known", "outside", "more")
    out = Saved(both.mapInArrow(_filled, "doc_id long, codes binary, logs double, n_known long"), "codes")
    seen.drop()
    return out


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes to the counts of their bigrams."""
    size = END + 1
    total = np.zeros(size * size, np.int64)
    for batch in batches:
        for part in slices(batch, 0):
            seq = flat(part.column(0))[0].astype(np.int64)
            if len(seq):
                total += np.bincount(_before(seq, END) * size + seq, minlength=size * size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def _pair_values(m: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """log10 of P(class | class before) / emission denominator; unseen words are summed over all classes of words."""
    k = len(m)
    after = m.sum(axis=0)
    prior = (after + 0.5) / (after.sum() + 0.5 * k)
    chance = np.concatenate([(m + PRIOR * k * prior[None, :]) / (m.sum(axis=1, keepdims=True) + PRIOR * k), prior[None, :]]) / denominator[None, :]
    return np.log10(np.concatenate([chance, chance[:, :CLASSES].sum(axis=1, keepdims=True)], axis=1))


class Model(NamedTuple):
    vocabulary: Vocabulary
    of: Saved  # h, n, class of every training word
    pair: np.ndarray  # log10 of transition by emission denominator, class before x class; see END, UNSEEN
    tokens: int
    distinct: int
    ends: int
    likelihoods: list[float]


def word_classes(docs: DataFrame, counts: DataFrame, clustered_words: int = CLUSTERED, lookup: int = LOOKUP, share: float = SHARE, key: bytes = PUBLIC) -> Classes:
    """docs: text of the training texts; counts: their words (h, n), hashed with key."""
    hashes, n, _ = most_frequent(counts, clustered_words, ties=True)
    vocabulary = Vocabulary(hashes, key)
    bigrams = docs.mapInArrow(_bigrams(vocabulary), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
    bigrams = Saved(bigrams, "bigrams")
    classes, m, values = clustered(bigrams.df, np.lexsort((hashes, -n)), len(hashes), share)
    bigrams.drop()
    of = _class_table(docs, vocabulary, n[: len(hashes)], classes, m)
    table_h, table_n, least = most_frequent(counts, lookup)
    got = of.df.where(F.col("n") >= least).select("h", "class").toArrow()
    table_c = got["class"].to_numpy()[np.argsort(got["h"].to_numpy().view(np.uint64))]
    return Classes(vocabulary, of, table_h, table_n, table_c, least, values)


def fitted(known: Classes, codes: DataFrame) -> Model:
    """The model of the training texts, given as codes."""
    size = END + 1
    cells = codes.select("codes").mapInArrow(_class_pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(size * size)
    every[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    every = every.reshape(size, size)
    n_docs = int(every[:, END].sum())
    tokens, kinds = np.zeros(size), np.zeros(size)
    for x in known.of.df.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect():
        tokens[x["class"]], kinds[x["class"]] = x["n"], x["c"]
    tokens[END], kinds[END] = n_docs, 1
    pair = _pair_values(every, tokens + 0.5 * (kinds + 1))
    return Model(known.vocabulary, known.of, pair, int(tokens.sum()), int(kinds.sum()) - (n_docs == 0), n_docs, known.likelihoods)


def trained(docs: DataFrame, counts: DataFrame, **options: float) -> Model:
    """docs: text of the training texts; counts: their words (h, n)."""
    known = word_classes(docs, counts, **options)
    return fitted(known, class_codes(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), known).df)


def _scored(model: Model):
    """Codes to sums over their tokens."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    value_of, ends, base = model.pair, model.ends, np.log10(model.tokens + 0.5 * (model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc_id, codes, logs, n_known = part.columns
                seq, offsets = flat(codes)
                n_tokens = np.diff(offsets)
                doc = np.repeat(np.arange(part.num_rows), n_tokens)
                sums = logs.to_numpy() + np.log10(ends + 0.5)
                score = sums + np.bincount(doc, value_of[_before(seq, END), seq], part.num_rows)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(n_tokens), pa.array(n_known.to_numpy() + int(ends > 0)), pa.array(sums - n_tokens * base), pa.array(score)], names)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, **options: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs. The model
    learns from the texts that are not held out. keyed: their digest is the key of word hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~held_out(F.col("doc_id"))).select("text")
    key = text_key(train) if keyed else PUBLIC
    counts = Saved(train.mapInArrow(_counter(key), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    known = word_classes(train, counts.df, key=key, **options)
    counts.drop()
    codes = class_codes(rows, known).df
    model = fitted(known, codes.where(~held_out(F.col("doc_id"))))
    known.of.drop()
    out = codes.mapInArrow(_scored(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), keyed=True)
