"""Regions grown from patch features: three clusters per slide, their circles and mean features.

Growth is sequential inside a slide, so a slide is grown in one task, but its features need not fit there: patches
arrive sorted, feature by feature, and go to an unnamed scratch file that the task maps into memory and the system
drops with it; growth touches the features of the frontier only. What a task holds is about 300 bytes a patch. No size
of slide is left out.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS = 3
REACH, DEFAULT_PATCH = 1.42, 512.0
#: Feature rows that are read at a time, where all are.
ROWS = 4096
_LABELS = "slide_id string, patch_idx int, cluster int"
_CIRCLES = "slide_id string, cluster_id string, center_x double, center_y double, radius double, count int"


def least_distance(xy: np.ndarray) -> float:
    """The least distance of two points. Any five points in a square of the best distance so far have a pair that
    beats it, so comparing each with the four next in its cell shrinks cells until at most four share one."""
    best = np.inf
    for a, b in ((0, 1), (1, 0)):
        ordered = xy[np.lexsort((xy[:, b], xy[:, a]))]
        best = min(best, float(np.sqrt(((ordered[1:] - ordered[:-1]) ** 2).sum(axis=1).min(initial=np.inf))))
    while 1e-6 < best < np.inf:
        cells = _Cells(xy, best)
        fullest = int(np.diff(np.append(np.flatnonzero(np.r_[True, cells.keys[1:] != cells.keys[:-1]]), len(xy))).max())
        near, before = xy[cells.order], best
        for step in range(1, min(fullest, 5)):
            same = cells.keys[step:] == cells.keys[:-step]
            best = min(best, float(np.sqrt(((near[step:] - near[:-step]) ** 2).sum(axis=1)[same].min(initial=np.inf))))
        if fullest > 4 and best < before:
            continue
        # cells of few points: each against those of the eight cells around it
        for shift in (1, cells.width - 1, cells.width, cells.width + 1):
            low = np.searchsorted(cells.keys, cells.keys + shift)
            for step in range(fullest):
                at = np.minimum(low + step, len(xy) - 1)
                met = cells.keys[at] == cells.keys + shift
                best = min(best, float(np.sqrt(((near[at] - near) ** 2).sum(axis=1)[met].min(initial=np.inf))))
        break
    return best


class _Cells:
    """Points by square cells of a side: those within ``reach`` (the side at most) of a point are in nine cells."""

    def __init__(self, xy: np.ndarray, side: float):
        self.xy, self.side = xy, side
        cell = np.floor((xy - xy.min(axis=0)) / side).astype(np.int64)
        self.width = int(cell[:, 1].max()) + 3
        own = cell[:, 0] * self.width + cell[:, 1] + 1
        self.order = np.argsort(own, kind="stable")
        self.own, self.keys = own, own[self.order]

    def near(self, i: int) -> np.ndarray:
        key, w = self.own[i], self.width
        bounds = np.searchsorted(self.keys, [key - w - 1, key - 1, key + w - 1, key - w + 2, key + 2, key + w + 2])
        others = np.concatenate([self.order[a:b] for a, b in zip(bounds[:3], bounds[3:], strict=True)])
        others = others[others != i]
        return others[((self.xy[others] - self.xy[i]) ** 2).sum(axis=1) <= self.side**2]


def patch_size(xy: np.ndarray) -> float:
    least = least_distance(xy)
    return least if 1e-6 < least < np.inf else DEFAULT_PATCH


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=-1))


def grow(xy: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, float]:
    """Cluster of each patch, and the patch size. Seeds stand in a triangle; the open patch most like its best
    touching cluster's mean comes next, by the similarity it had when it was met. features may be a mapped file: rows
    are read when their patches are met. Of what a patch was met with, only the best is queued, as it is popped first."""
    size = patch_size(xy)
    cells = _Cells(xy, REACH * size)
    low, high = xy.min(axis=0), xy.max(axis=0)
    (cx, cy), (w, h) = (low + high) / 2, high - low
    targets = [(cx, cy + h * 0.25), (cx - w * 0.25, cy - h * 0.25), (cx + w * 0.25, cy - h * 0.25)]
    seeds = [int(np.argmin(((xy - t) ** 2).sum(axis=1))) for t in targets]
    label, touched = np.full(len(xy), -1, np.int8), np.zeros((len(xy), CLUSTERS), bool)
    best, best_k = np.full(len(xy), -np.inf), np.full(len(xy), CLUSTERS, np.int8)
    means, members = np.asarray(features[seeds], np.float64), [1] * CLUSTERS
    mean_norms = _norms(means)
    for k, s in enumerate(seeds):
        label[s] = k
    norms = np.concatenate([_norms(np.asarray(features[a : a + ROWS], np.float64)) for a in range(0, len(xy), ROWS)])

    def similarities(rows: np.ndarray) -> np.ndarray:
        both = norms[rows][:, None] * mean_norms
        dots = (np.asarray(features[rows], np.float64)[:, None, :] * means).sum(axis=2)
        return np.divide(dots, both, out=np.zeros_like(dots), where=both > 0)

    queue: list[tuple[float, int, int]] = []

    def meet(rows: np.ndarray, touching: np.ndarray) -> None:
        s = np.where(touching, similarities(rows), -np.inf)
        k = np.argmax(s, axis=1)
        s = s[np.arange(len(rows)), k]
        better = np.flatnonzero((s > best[rows]) | ((s == best[rows]) & (k < best_k[rows])))
        best[rows[better]], best_k[rows[better]] = s[better], k[better]
        for entry in zip((-s[better]).tolist(), rows[better].tolist(), k[better].tolist(), strict=True):
            heapq.heappush(queue, entry)

    around = [cells.near(s) for s in seeds]
    first = np.unique(np.concatenate(around))
    first = first[label[first] < 0]
    if len(first):
        meet(first, np.stack([np.isin(first, a) for a in around], axis=1))
    for k, s in enumerate(seeds):
        touched[around[k], label[s]] = True
    while queue:
        _, i, k = heapq.heappop(queue)
        if label[i] >= 0:
            continue
        label[i] = k
        members[k] += 1
        means[k] += (np.asarray(features[i], np.float64) - means[k]) / members[k]
        mean_norms[k] = _norms(means[k])
        near = cells.near(i)
        touched[near, k] = True
        near = near[label[near] < 0]
        if len(near):
            meet(near, touched[near])
    rest = np.flatnonzero(label < 0)
    for a in range(0, len(rest), ROWS):
        label[rest[a : a + ROWS]] = np.argmax(similarities(rest[a : a + ROWS]), axis=1)
    return label, size


def squared_distances(cells: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """For distinct cells (row, column), sorted, of a grid: the squared distance to the nearest cell of the grid that
    isn't among them; the longer side, squared, if all are. Exact, in integers; work and memory are linear in the cells
    given, however large the grid.

    A column's runs of cells give the distance up and down. Along a row's run the nearest clear cell is found by way
    of the lower envelope of the parabolas of its columns and of the clear cells at its ends; all runs take their next
    step together."""
    height, width = shape
    if len(cells) == height * width:
        return np.full(len(cells), max(shape) ** 2, np.int64)
    far = height + width + 1
    down = np.lexsort((cells[:, 0], cells[:, 1]))
    own = cells[down]
    starts = np.flatnonzero(np.r_[True, (own[1:, 1] != own[:-1, 1]) | (own[1:, 0] != own[:-1, 0] + 1)])
    first, last = own[starts, 0], own[np.append(starts[1:], len(own)) - 1, 0]
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))
    up = np.where(first[run] > 0, own[:, 0] - first[run] + 1, far)
    below = np.where(last[run] < height - 1, last[run] - own[:, 0] + 1, far)
    column = np.empty(len(cells), np.int64)
    column[down] = np.minimum(up, below)

    starts = np.flatnonzero(np.r_[True, (cells[1:, 0] != cells[:-1, 0]) | (cells[1:, 1] != cells[:-1, 1] + 1)])
    lengths = np.diff(np.append(starts, len(cells)))
    left = (cells[starts, 1] > 0).astype(np.int64)
    right = (cells[starts + lengths - 1, 1] < width - 1).astype(np.int64)
    order = np.argsort(-(lengths + left + right), kind="stable")  # longest first: runs at work are always the first ones
    starts, lengths, left, right = starts[order], lengths[order], left[order], right[order]
    m = lengths + left + right
    base = np.cumsum(m) - m
    heights = np.zeros(int(m.sum()), np.int64)  # squared; 0 for the clear cells at the ends
    inner = np.repeat(base + left, lengths) + np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    source = np.repeat(starts, lengths) + np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    heights[inner] = column[source] ** 2
    site, since, top = np.zeros_like(heights), np.zeros_like(heights), np.zeros(len(m), np.int64)
    at_work = np.searchsorted(-m, -np.arange(int(m[0])), "left")  # runs of more than so many cells
    for u in range(1, int(m[0])):
        n = int(at_work[u])
        rising = np.arange(n)
        while len(rising):
            at = base[rising] + np.maximum(top[rising], 0)
            old = (since[at] - site[at]) ** 2 + heights[base[rising] + site[at]]
            new = (since[at] - u) ** 2 + heights[base[rising] + u]
            rising = rising[(top[rising] >= 0) & (old > new)]
            top[rising] -= 1
        empty = np.flatnonzero(top[:n] < 0)
        top[empty] = 0
        site[base[empty]], since[base[empty]] = u, 0
        rest = np.flatnonzero(site[base[:n] + top[:n]] != u)
        v = site[base[rest] + top[rest]]
        begin = 1 + (u * u - v * v + heights[base[rest] + u] - heights[base[rest] + v]) // (2 * (u - v))
        inside = begin < m[rest]
        rest, begin = rest[inside], begin[inside]
        top[rest] += 1
        site[base[rest] + top[rest]], since[base[rest] + top[rest]] = u, begin
    out = np.empty_like(heights)
    for u in range(int(m[0]) - 1, -1, -1):
        n = int(at_work[u])
        at = base[:n] + top[:n]
        out[base[:n] + u] = (u - site[at]) ** 2 + heights[base[:n] + site[at]]
        top[:n] -= since[at] == u
    result = np.empty(len(cells), np.int64)
    result[source] = out[inner]
    return result


def inscribed_circle(cells: np.ndarray, shape: tuple[int, int]) -> tuple[float, int, int]:
    """Radius, row and column of the largest circle inside the cells (row, column); the first one by rows on ties."""
    cells = np.unique(cells, axis=0)
    d = squared_distances(cells, shape)
    at = int(np.argmax(d))
    return float(np.sqrt(d[at])), int(cells[at, 0]), int(cells[at, 1])


def _slides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """slide_id, patch_idx, coordinates and features of each slide, from rows sorted by slide. Features are in a
    mapped scratch file that is gone when the next slide is asked for."""
    for slide, parts in _runs(batches):
        with tempfile.TemporaryFile() as scratch:
            idx, xy, kind, dim = [], [], None, None
            for part in parts:
                flat = part.column("feature").flatten()
                kind, dim = flat.to_numpy(zero_copy_only=False).dtype, len(flat) // part.num_rows
                flat.to_numpy(zero_copy_only=False).tofile(scratch)
                idx.append(part.column("patch_idx").to_numpy())
                xy.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], axis=1))
            idx, xy = np.concatenate(idx), np.concatenate(xy)
            scratch.flush()
            features = np.memmap(scratch, kind, "r", shape=(len(idx), dim)) if dim else np.zeros((len(idx), 1))
            yield slide, idx, xy, features
            del features


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Runs of rows of one slide, each as an iterator of parts of batches that must be used up in its turn."""
    state = {"batch": None, "at": 0}

    def more() -> bool:
        while state["batch"] is None or state["at"] >= state["batch"].num_rows:
            state["batch"], state["at"] = next(batches, None), 0
            if state["batch"] is None:
                return False
        return True

    def parts(slide: object) -> Iterator[pa.RecordBatch]:
        while more():
            ids = state["batch"].column("slide_id")
            here = ids.slice(state["at"])
            same = pc.is_null(here) if slide is None else pc.fill_null(pc.equal(here, slide), False)
            n = pc.index(same, False).as_py()
            n = len(here) if n < 0 else n
            if n:
                yield state["batch"].slice(state["at"], n)
                state["at"] += n
            if n < len(here):
                return

    while more():
        slide = state["batch"].column("slide_id")[state["at"]].as_py()
        yield slide, parts(slide)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slide, idx, xy, features in _slides(batches):
        if len(idx) > CLUSTERS:
            label, _ = grow(xy, features)
            yield pa.RecordBatch.from_arrays([pa.array([slide] * len(idx), pa.string()), pa.array(idx.astype(np.int32)), pa.array(label.astype(np.int32))], ["slide_id", "patch_idx", "cluster"])


def _circled(rows: pd.DataFrame) -> pd.DataFrame:
    slide, xy, label = rows["slide_id"].iloc[0], rows[["x", "y"]].to_numpy(float), rows["cluster"].to_numpy()
    size, low = patch_size(xy), xy.min(axis=0)
    grid = np.round((xy - low) / size).astype(np.int64)[:, ::-1]
    shape = (int(grid[:, 0].max()) + 1, int(grid[:, 1].max()) + 1)
    out = []
    for k in range(CLUSTERS):
        own = grid[label == k]
        r, row, col = inscribed_circle(own, shape) if len(own) else (0.0, 0, 0)
        out.append((slide, f"cluster_{k}", *((col * size + low[0], row * size + low[1]) if len(own) else (0.0, 0.0)), r * size, len(own)))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _CIRCLES.split(", ")])


def grow_regions(patches: DataFrame) -> DataFrame:
    """slide_id, patch_idx, cluster (0 to 2). Slides of three patches or fewer give nothing; those of any other size
    are grown. Features of a slide must be of one length."""
    rows = patches.select(F.col("slide_id").cast("string").alias("slide_id"), "patch_idx", "x", "y", "feature")
    return rows.repartition("slide_id").sortWithinPartitions("slide_id", "patch_idx", "x", "y").mapInArrow(_grown, _LABELS)


def circles(patches: DataFrame, labels: DataFrame) -> DataFrame:
    """The largest inscribed circle and the size of each cluster; features are not moved for it."""
    rows = patches.select("slide_id", "patch_idx", "x", "y").join(labels, ["slide_id", "patch_idx"])
    return rows.groupBy("slide_id").applyInPandas(_circled, _CIRCLES)


def cluster_means(patches: DataFrame, labels: DataFrame) -> DataFrame:
    """slide_id, cluster, size, feature: the mean of each cluster by element; partial sums meet, not rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = patches.select("slide_id", "patch_idx", array_to_vector("feature").alias("v")).join(labels, ["slide_id", "patch_idx"])
    out = rows.groupBy("slide_id", "cluster").agg(F.count("*").alias("size"), Summarizer.mean(F.col("v")).alias("m"))
    return out.select("slide_id", "cluster", "size", vector_to_array("m").alias("feature"))
