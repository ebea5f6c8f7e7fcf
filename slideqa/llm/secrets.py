"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 12 or more characters of `[A-Za-z0-9+/_=-]`. The network sees
the candidate and its surroundings as bytes (an embedding, a convolution, rectified, pooled by maximum and
mean, one logistic output). A long candidate is seen in overlapping windows to its end, each with what stands
around it, and has the highest of their probabilities. The network is trained in numpy on labelled findings: made ones of common shapes, and a
bounded sample of the corpus' candidates that a pattern found. What no pattern found has no label and isn't
learned from. A second part of the made ones calibrates the output (Platt) and sets the highest threshold that keeps
the wanted recall, a third measures it; made secrets without a candidate count as missed. The text is read once; candidates and pattern spans are kept in a table, and the trained network judges those.

Defined results: null counts as empty; spans are code points, end exclusive; rows are scanned one by one, so
repeated rows give repeated results; an empty table gives no rows; texts and candidates are seen to their end.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table
from slideqa.llm.text import flat, lean, points, slices

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LEAST_RUN = 12
#: Bytes before a window's part of a candidate, of it and after it that the network sees; bytes from window to window.
BEFORE, INSIDE, AFTER = 28, 36, 16
STRIDE = 18
WIDTH = BEFORE + INSIDE + AFTER
#: Most corpus candidates that a pattern found, and made findings of each label, that the network is fitted on.
SAMPLE, MADE = 1500, 1500
RECALL = 0.98
SEED = 5

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
PLACEHOLDER = "[secret]"
CANDIDATE = ("start", "end", "window", "known", "within")
_FOUND = "doc_id long, base array<struct<start:int,end:int,kind:int>>, candidates array<struct<start:int,end:int,window:binary,known:boolean,within:binary>>"


class Network(NamedTuple):
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1
    #: Share of secrets found among made findings that neither training, calibration nor the threshold have seen.
    recall: float = 0.0


CHANNELS, SPAN, FILTERS = 8, 5, 24
#: Training steps at least, however few findings there are.
LEAST_STEPS = 600
#: Places of filters inside the candidate, over which the mean is taken: what stands around doesn't dilute it.
OWN = slice(BEFORE, BEFORE + INSIDE - SPAN + 1)


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least`` bytes that don't cross texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    s = np.flatnonzero(inside & (~before | edge[:-1]))
    e = np.flatnonzero(inside & (~after | edge[1:])) + 1
    keep = e - s >= least
    return s[keep], e[keep]


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the assign and access patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def window_starts(s: int, e: int) -> list[int]:
    """Where the windows of a candidate begin, so that each byte of it is in one."""
    last = max(s, e - INSIDE)
    return [*range(s, last, STRIDE), last]


def scanned(texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes, bool, bytes]]]]:
    """For each text the pattern spans, by start and kind, and the candidates with windows of bytes (one behind the
    other), whether a pattern overlaps them, and a byte for each window, 1 if a pattern overlaps its part."""
    data, offsets = flat(texts)
    raw, at = data.tobytes(), points(data)
    n = len(offsets) - 1
    if not len(data):
        yield from (([], []) for _ in range(n))
        return
    hex_s, hex_e = _runs(_HEX[data], offsets, LEAST["hex"])
    run_s, run_e = _runs(_RUN[data], offsets, LEAST_RUN)
    hex_of, run_of = np.searchsorted(hex_s, offsets), np.searchsorted(run_s, offsets)
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        first = int(at[a])
        spans = pattern_spans(raw[a:b].decode())
        spans += [(int(at[hex_s[k]]) - first, int(at[hex_e[k]]) - first, 2) for k in range(hex_of[i], hex_of[i + 1])]
        spans.sort(key=lambda x: (x[0], x[2]))
        candidates = []
        for k in range(run_of[i], run_of[i + 1]):
            s, e = int(run_s[k]), int(run_e[k])
            start, end = int(at[s]) - first, int(at[e]) - first
            window, within = [], []
            over = [(x, y) for x, y, _ in spans if x < end and start < y]
            for p in window_starts(s, e):
                q = min(e, p + INSIDE)
                window.append(raw[max(a, p - BEFORE) : p].rjust(BEFORE, b"\0") + raw[p:q].ljust(INSIDE, b"\0") + raw[q : min(b, q + AFTER)].ljust(AFTER, b"\0"))
                # a run is ASCII, so its bytes are its code points
                within.append(any(x < start + q - s and start + p - s < y for x, y in over))
            candidates.append((start, end, b"".join(window), bool(over), bytes(within)))
        yield spans, candidates


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("window", pa.binary()), ("known", pa.bool_()), ("within", pa.binary())]))
    for batch in batches:
        for part in slices(batch):
            found = list(scanned(part.column(1)))
            base = [[dict(zip(("start", "end", "kind"), x, strict=True)) for x in f[0]] for f in found]
            others = [[dict(zip(CANDIDATE, x, strict=True)) for x in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(others, seen)], ["doc_id", "base", "candidates"])


def _inputs(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)


_FLAG = np.zeros((WIDTH, 1))
_FLAG[BEFORE : BEFORE + INSIDE] = 1


def _forward(net: Network, x: np.ndarray):
    e = np.concatenate([net.embedding[x], np.broadcast_to(_FLAG, (len(x), WIDTH, 1))], axis=2)
    cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).reshape(len(x), WIDTH - SPAN + 1, -1)
    z = np.maximum(0, cols @ net.filters + net.bias)
    top = z.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z[:, OWN].mean(axis=1)], axis=1)
    return cols, z, top, pooled, pooled @ net.weights + net.offset


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    """Outputs alone: what a byte adds at each place of a filter is looked up."""
    filters = net.filters.reshape(CHANNELS + 1, SPAN, FILTERS)
    size = WIDTH - SPAN + 1
    z = np.einsum("pj,jf->pf", np.lib.stride_tricks.sliding_window_view(_FLAG[:, 0], SPAN), filters[CHANNELS]) + net.bias
    z = np.repeat(z[None], len(x), axis=0)
    for j in range(SPAN):
        z += (net.embedding @ filters[:CHANNELS, j])[x[:, j : j + size]]
    np.maximum(0, z, out=z)
    return np.concatenate([z.max(axis=1), z[:, OWN].mean(axis=1)], axis=1) @ net.weights + net.offset


def probabilities(net: Network, windows: list[bytes]) -> np.ndarray:
    """Calibrated probabilities, in blocks of bounded size. Several windows may stand in one, one behind the other."""
    out = [np.zeros(0)]
    windows = [w[i : i + WIDTH] for w in windows for i in range(0, len(w), WIDTH)]
    for i in range(0, len(windows), 512):
        logit = _logits(net, _inputs(windows[i : i + 512]))
        out.append(1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -30, 30))))
    return np.concatenate(out)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    cols, z, top, pooled, logit = _forward(net, x)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    d_pooled = d[:, None] * net.weights
    d_z = np.zeros_like(z)
    d_z[:, OWN] = d_pooled[:, None, FILTERS:] / (OWN.stop - OWN.start)
    np.put_along_axis(d_z, top[:, None], np.take_along_axis(d_z, top[:, None], 1) + d_pooled[:, None, :FILTERS], 1)
    d_z *= z > 0
    d_cols = (d_z @ net.filters.T).reshape(len(x), -1, CHANNELS + 1, SPAN)
    d_e = np.zeros((len(x), WIDTH, CHANNELS))
    for j in range(SPAN):
        d_e[:, j : j + d_cols.shape[1]] += d_cols[:, :, :CHANNELS, j]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, x, d_e)
    return [d_embedding, np.einsum("npc,npf->cf", cols, d_z), d_z.sum((0, 1)), pooled.T @ d, d.sum(keepdims=True)[0:1]]


def trained(windows: list[bytes], labels: list[bool], recall: float = RECALL, epochs: int = 12, missed: int = 0, of: list[int] | None = None, more: list[bytes] | None = None) -> Network:
    """Fits the network on three fifths of the findings, calibrates it and its threshold on the fourth, and measures
    its recall on the last. missed: secrets without a window, of which as large a part counts for the threshold and
    the recall. of: the finding (0, 1, ...) of each window, if findings have several: they stay together, and a
    secret is found by its best window. more: windows of further secrets, to fit on alone."""
    r = np.random.Generator(np.random.PCG64(SEED))
    x, y, of = _inputs(windows), np.array(labels, float), np.arange(len(labels)) if of is None else np.array(of)
    n = int(of.max()) + 1 if len(of) else 0
    place = np.argsort(r.permutation(n))[of]
    order = np.argsort(place, kind="stable")
    x, y, of, place = x[order], y[order], of[order], place[order]
    cut, end = np.searchsorted(place, [n * 3 // 5, n * 4 // 5]).tolist()
    fit_x, fit_y = (np.concatenate([x[:cut], _inputs(more)]), np.concatenate([y[:cut], np.ones(len(more))])) if more else (x[:cut], y[:cut])
    net = [r.normal(0, 0.3, (256, CHANNELS)), r.normal(0, 0.2, ((CHANNELS + 1) * SPAN, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(max(epochs, -(-LEAST_STEPS // max(1, -(-len(fit_y) // 64))))):
        mixed = r.permutation(len(fit_y))
        for i in range(0, len(fit_y), 64):
            step += 1
            for p, g, m, v in zip(net, _gradients(Network(*net), fit_x[mixed[i : i + 64]], fit_y[mixed[i : i + 64]]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logit = np.concatenate([_forward(Network(*net), x[i : i + 512])[-1] for i in range(cut, len(y), 512)] or [np.zeros(0)])
    a, b, own = 1.0, 0.0, logit[: end - cut]
    for _ in range(300):
        e = 1 / (1 + np.exp(-np.clip(a * own + b, -30, 30))) - y[cut:end]
        a, b = a - 0.1 * float((e * own).mean() if len(e) else 0), b - 0.1 * float(e.mean() if len(e) else 0)
    best = np.full(n, -1.0)
    np.maximum.at(best, of[cut:], 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))))

    def found(part: slice) -> np.ndarray:
        """Ascending probabilities of the secrets of a part; missed ones have none."""
        good = np.sort(best[np.unique(of[part][y[part] == 1])])
        return np.concatenate([np.zeros(round(missed * len(good) / max(1, len(np.unique(of[y == 1]))))), good])

    good, last = found(slice(cut, end)), found(slice(end, None))
    if not len(good):
        return Network(*net, slope=a, shift=b)
    threshold = float(good[int((1 - recall) * len(good))])
    return Network(*net, slope=a, shift=b, threshold=threshold, recall=float((last >= threshold).mean()) if len(last) else 0.0)


STEMS = "inter trans over under contra multi auto electro photo micro hydro geo psycho respons possib character commun govern environ develop present represent organ admin temper constitu instru inform circum philo techno verant gesell wissen schaft bundes haupt arbeit geschwind versicher unter zusammen recht staat verwalt entwick gouverne etabl develop conse particul carac recono respons desarr conoc estable".split()
ENDS = "ation ations ing ings ly ability ibility ment ments ness ically ional ionally ization isch ische lich lichkeit keit ung ungen schaft schaften heit iert ement ements iques ique euse amiento amente aciones idad idades ando iendo ography ological istically".split()


def _word(r: np.random.Generator) -> str:
    """A made long word of letters, as languages build them, in one of three cases."""
    any_of = lambda xs: xs[r.integers(len(xs))]
    starts, middles, closes = "b c d f g h l m n p r s t v w st th sch ch tr pr br gr bl fl sp".split() + [""] * 3, "a e i o u a e i o ou ea au ei ie io".split(), [""] * 6 + "n r s t l nd ng st th ch rs ns tion".split()
    out = any_of(STEMS) + any_of(STEMS) * int(r.integers(2)) if r.integers(2) else ""
    while len(out) < LEAST_RUN - 2 or (len(out) < 22 and r.integers(3) == 0):
        out += any_of(starts) + any_of(middles) + any_of(closes)
    if r.integers(2) or len(out) < LEAST_RUN:
        out += any_of(ENDS)
    return any_of([str, str, str, str.capitalize, str.upper])(out)


def _made(n: int, seed: int) -> tuple[list[bytes], list[bool], list[int], int]:
    """Windows of n made secrets and n harmless runs, their labels and findings, and how many secrets have no
    candidate. A window of a secret's run that holds less than ``LEAST_RUN`` bytes of the secret (or all, if it is
    shorter) is harmless if it holds none, else left out."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    prose = "the and of to in is that it for on was with as by this from are or an be".split()
    around = lambda: " ".join(prose[i] for i in r.integers(0, len(prose), 5)) + " "
    texts, labels, values = [], [], []
    for i in range(2 * n):
        secret, value = i % 2 == 0, ""
        if secret:
            name = ("password", "secret", "api_key", "token", "auth", "key", "pwd", "credential")[r.integers(8)]
            front = ("", "", pick(lower, 3) + "_", pick(lower, 2) + "_" + pick(lower, 4) + "_", pick(lower, 4) + "-")[r.integers(5)]
            value = (pick("0123456789abcdef", 32), front + pick(lower + upper + digits, int(r.integers(20, 41))), "AKIA" + pick(upper + digits, 16), pick(lower + upper + digits + "+/", 40), front + pick(lower + upper, int(r.integers(16, 41))), pick(lower + upper, int(r.integers(16, 41))), pick(lower + upper + digits, int(r.integers(12, 21))))[r.integers(7)]
            body = (f"{name}={value}", f'{name} = "{value}"', f"{name}: {value}", value, value, value, value, "/".join(_word(r)[: int(r.integers(3, 12))] for _ in range(int(r.integers(2, 6)))) + "/" + value, "_".join(_word(r)[: int(r.integers(3, 12))] for _ in range(int(r.integers(2, 6)))).upper() + "=" + value)[r.integers(9)]
        else:
            body = (f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{pick(digits, 2)}", pick(lower, 9) + "-" + pick(digits, 4), pick(lower, 6) + "/" + pick(lower, 7) + pick(digits, 2), "x" * 11 + pick(digits, 2), pick(upper, 6) + "-" + pick(digits, 6), "-".join(pick(lower, int(r.integers(3, 8))) for _ in range(3)) + f"-v{r.integers(10)}.{r.integers(10)}-" + pick(digits, 2), pick(lower, 8) + "_" + pick(lower, 7) + "_" + pick(digits, 3), "/".join(_word(r)[: int(r.integers(3, 12))] for _ in range(4)), "_".join(_word(r)[: int(r.integers(3, 12))] for _ in range(3)), "-=_"[r.integers(3)] * int(r.integers(12, 40)), *(_word(r) for _ in range(7)))[r.integers(17)]
        texts.append(around() + body + " " + around())
        labels.append(secret)
        values.append(value)
    windows, known, of, missed, n_of = [], [], [], 0, 0
    for text, (_, candidates), label, value in zip(texts, scanned(pa.array(texts)), labels, values, strict=True):
        low = text.rindex(value) if label else 0
        high = low + len(value)
        mine = [c for c in candidates if not label or (c[0] < high and low < c[1])][:1]
        for start, end, every, *_ in mine:
            for i, p in enumerate(window_starts(start, end)):
                held = min(min(end, p + INSIDE), high) - max(p, low) if label else 0
                if held <= 0 or held >= min(LEAST_RUN, high - low):
                    windows.append(every[i * WIDTH : (i + 1) * WIDTH])
                    known.append(held > 0)
                    of.append(n_of)
            n_of += 1
        missed += label and not mine
    return windows, known, of, missed


def made_findings(n: int = MADE, seed: int = SEED) -> tuple[list[bytes], list[bool]]:
    """Findings of common shapes: n secrets (keys, tokens, passwords, with digits or without) and n harmless runs
    (dates, versions, numbers, names, paths, rulers, long words)."""
    return _made(n, seed)[:2]


def fitted_network(candidates: DataFrame, sample: int = SAMPLE) -> Network:
    """candidates: window, known, within. At most ``sample`` distinct windows that a pattern found join the made
    findings in training alone: those of the smallest hashes, so the choice doesn't depend on how rows are dealt out.
    Calibration, threshold and recall rest on made findings, whose labels no pattern gave."""
    windows, labels, of, missed = _made(MADE, SEED)
    at = F.explode(F.sequence(F.lit(1), F.length("within"))).alias("at")
    rows = candidates.where("known").select("window", "within", at).where(F.substring("within", F.col("at"), 1) == F.lit(b"\1"))
    rows = rows.select(F.substring("window", (F.col("at") - 1) * WIDTH + 1, F.lit(WIDTH)).alias("window")).distinct()
    rows = rows.orderBy(F.xxhash64("window"), "window").limit(sample).collect()
    return trained(windows, labels, missed=missed, of=of, more=[bytes(r.window) for r in rows])


def _joined_spans(net: Network, spans: list, candidates: list) -> list[tuple[int, int, int]]:
    """All spans by start and kind: the pattern ones, and candidates that no pattern overlaps but the network takes."""
    new = [c for c in candidates if not c["known"]]
    every = probabilities(net, [c["window"] for c in new])
    first = np.cumsum([0] + [len(c["within"]) for c in new])[:-1]
    p = np.maximum.reduceat(every, first) if new else every
    out = [(s["start"], s["end"], s["kind"]) for s in spans] + [(c["start"], c["end"], 3) for c, q in zip(new, p, strict=True) if q >= net.threshold]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _judged(net: Network):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_joined_spans(net, b, c) for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return run


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_scan), _FOUND)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind; by start, then kind): a row per row of docs."""
    found = Saved(_found(docs, id_col, text_col), "found")
    net = fitted_network(found.df.select(F.explode("candidates").alias("c")).select("c.window", "c.known", "c.within"))
    return found.df.mapInArrow(lean(_judged(net)), "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def _redacted(net: Network, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                for i, (spans, candidates) in enumerate(scanned(part.column(at))):
                    spans = [dict(zip(("start", "end", "kind"), x, strict=True)) for x in spans]
                    candidates = [dict(zip(CANDIDATE, x, strict=True)) for x in candidates]
                    end, pieces = 0, []
                    for s, e, _ in _joined_spans(net, spans, candidates):
                        if s >= end:
                            pieces += [texts[i][end:s], PLACEHOLDER]
                        end = max(end, e)
                    if pieces:
                        texts[i] = "".join(pieces) + texts[i][end:]
                yield part.set_column(at, part.schema.names[at], pa.array(texts, pa.string()))

    return run


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret replaced by a placeholder; all rows and columns stay."""
    candidates = Saved(_found(docs, id_col, text_col).select(F.explode("candidates").alias("c")).select("c.window", "c.known", "c.within"), "candidates")
    net = fitted_network(candidates.df)
    candidates.drop()
    return docs.mapInArrow(lean(_redacted(net, docs.columns.index(text_col))), docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
