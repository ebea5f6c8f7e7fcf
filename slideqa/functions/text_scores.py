"""ROUGE-L and METEOR of text pairs.

Both are row-wise algorithms over token sequences, so they run as Arrow batches. The longest common subsequence goes by
bits, the shorter text's tokens being the bits: pairs of up to 512 tokens on that side take their steps together, as
columns of 64-bit words, bucketed by length; longer ones each go by one long integer. METEOR matches the k-th
occurrence of each word on either side, in linear time.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUGE = "rouge_l_precision double, rouge_l_recall double, rouge_l_fmeasure double"
_METEOR = "meteor_score double, precision double, recall double, fmean double, penalty double"


def lcs_length(a: list, b: list) -> int:
    """Bit-parallel: bit i of v is clear where extending the common subsequence at a[i] gained one."""
    where: dict = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


#: 64-bit words of the shorter side up to which pairs are worked on together, and steps times pairs of such a group.
WORDS, CELLS = 8, 1 << 21


def lcs_lengths(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """The length of the longest common subsequence of each pair, whatever their order."""
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    words = np.array([-(-len(x) // 64) for x in short], np.int64)
    steps = np.array([len(x) for x in long], np.int64)
    for i in np.flatnonzero(words > WORDS).tolist():
        out[i] = lcs_length(short[i], long[i])
    for w in range(1, WORDS + 1):
        rows = np.flatnonzero(words == w)
        rows = rows[np.argsort(-steps[rows], kind="stable")]  # longest first: pairs at work are always the first ones
        at = 0
        while at < len(rows):
            to = at + max(1, CELLS // int(steps[rows[at]]))
            some = rows[at:to]
            out[some] = _together([short[i] for i in some], [long[i] for i in some], w)
            at = to
    return out


def _together(short: list[list[str]], long: list[list[str]], width: int) -> np.ndarray:
    n = len(short)
    sizes, steps = (np.array([len(x) for x in side], np.int64) for side in (short, long))
    known: dict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter((known[t] for side in (short, long) for x in side for t in x), np.int64, int(sizes.sum() + steps.sum()))
    kinds = len(known)
    pair = [np.repeat(np.arange(n), s) for s in (sizes, steps)]
    place = [np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in (sizes, steps)]
    keys, row = np.unique(pair[0] * kinds + ids[: sizes.sum()], return_inverse=True)
    masks = np.zeros((len(keys) + 1, width), np.uint64)  # where in its text each token stands; the last row is for tokens it lacks
    np.bitwise_or.at(masks, (row, place[0] // 64), np.uint64(1) << (place[0] % 64).astype(np.uint64))
    wanted = pair[1] * kinds + ids[sizes.sum() :]
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    look = np.full((int(steps[0]), n), len(keys), np.int64)
    look[place[1], pair[1]] = np.where(keys[found] == wanted, found, len(keys))
    every = np.clip(sizes[:, None] - 64 * np.arange(width), 0, 64)
    full = np.where(every == 64, np.uint64(2**64 - 1), (np.uint64(1) << (every % 64).astype(np.uint64)) - np.uint64(1))
    v = full.copy()
    at_work = np.searchsorted(-steps, -np.arange(int(steps[0])), "left")
    for j, k in enumerate(at_work.tolist()):
        own = v[:k]
        u = own & masks[look[j, :k]]
        rest, carry = own ^ u, np.zeros(k, np.uint64)
        for i in range(width):
            one = own[:, i] + u[:, i]
            total = one + carry
            carry = ((one < u[:, i]) | (total < one)).astype(np.uint64)
            v[:k, i] = (total | rest[:, i]) & full[:k, i]
    return sizes - np.bitwise_count(v).sum(axis=1).astype(np.int64)


def rouge_tokens(text: str | None, words: bool = True) -> list[str]:
    text = (text or "").lower()
    return [t for t in (w.strip(string.punctuation) for w in text.split()) if t] if words else list(text)


def meteor_tokens(text: str | None) -> list[str]:
    return "".join(c if c.isalnum() or c in "'-" else " " for c in (text or "").lower()).split(" ")


def rouge_of(predictions: list[str | None], references: list[str | None], words: bool = True, beta: float = 1.0) -> np.ndarray:
    """Precision, recall and F of each pair; zeros where nothing is in common."""
    p, r = ([rouge_tokens(t, words) for t in side] for side in (predictions, references))
    common = lcs_lengths(p, r)
    n, m = (np.array([max(1, len(x)) for x in side]) for side in (p, r))
    precision, recall = common / n, common / m
    with np.errstate(invalid="ignore"):
        f = (1 + beta**2) * precision * recall / (beta**2 * precision + recall)
    return np.stack([precision, recall, np.where(common > 0, f, 0.0)], axis=1)


def rouge_scores(prediction: str | None, reference: str | None, words: bool = True, beta: float = 1.0) -> tuple[float, float, float]:
    return tuple(rouge_of([prediction], [reference], words, beta)[0].tolist())


def meteor_scores(prediction: str | None, reference: str | None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> tuple[float, float, float, float, float]:
    p, r = ([t for t in meteor_tokens(x) if t] for x in (prediction, reference))
    if not p or not r:
        return 0.0, 0.0, 0.0, 0.0, 1.0
    places = defaultdict(list)
    for i, t in enumerate(r):
        places[t].append(i)
    seen: Counter = Counter()
    matches, chunks, last = 0, 0, None
    for i, t in enumerate(p):
        k = seen[t]
        if k < len(places.get(t, ())):
            seen[t] += 1
            here = (i, places[t][k])
            chunks += last is None or here != (last[0] + 1, last[1] + 1)
            matches, last = matches + 1, here
    if not matches:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    precision, recall = matches / len(p), matches / len(r)
    fmean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    penalty = gamma * (chunks / matches) ** beta
    return fmean * (1 - penalty), precision, recall, fmean, penalty


def rouge_l(prediction: Column, reference: Column, words: bool = True, beta: float = 1.0) -> Column:
    """Struct of rouge_l_precision, rouge_l_recall, rouge_l_fmeasure."""

    @F.pandas_udf(_ROUGE)
    def run(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(rouge_of(p.tolist(), r.tolist(), words, beta), columns=[x.split()[0] for x in _ROUGE.split(", ")])

    return run(prediction, reference)


def meteor(prediction: Column, reference: Column, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> Column:
    """Struct of meteor_score, precision, recall, fmean, penalty."""

    @F.pandas_udf(_METEOR)
    def run(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([meteor_scores(x, y, alpha, beta, gamma) for x, y in zip(p, r, strict=True)], columns=[x.split()[0] for x in _METEOR.split(", ")])

    return run(prediction, reference)
