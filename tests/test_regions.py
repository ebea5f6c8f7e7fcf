"""Growth and circles against plain versions."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from slideqa.operators import regions


def plain_near(xy):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1)) + np.diag([np.inf] * len(xy))
    size = float(d.min()) if d.min() > 1e-6 else 512.0
    return size, [np.flatnonzero(row**2 <= (1.42 * size) ** 2).tolist() for row in d]


def plain_grow(xy, features):
    """All that a patch was met with is queued; whom it touches is looked up anew each time."""
    features = features.astype(float)
    size, near = plain_near(xy)
    low, high = xy.min(axis=0), xy.max(axis=0)
    (cx, cy), (w, h) = (low + high) / 2, high - low
    seeds = [int(np.argmin(((xy - t) ** 2).sum(axis=1))) for t in ((cx, cy + h * 0.25), (cx - w * 0.25, cy - h * 0.25), (cx + w * 0.25, cy - h * 0.25))]
    label, means, members = [-1] * len(xy), features[seeds].copy(), [1, 1, 1]
    for k, s in enumerate(seeds):
        label[s] = k

    def like(i, k):
        both = np.sqrt((features[i] ** 2).sum()) * np.sqrt((means[k] ** 2).sum())
        return (features[i] * means[k]).sum() / both if both else 0.0

    def entry(i, ks):
        return min((-like(i, k), i, k) for k in ks)

    queue = [entry(i, [k for k in range(3) if i in near[seeds[k]]]) for i in range(len(xy)) if label[i] < 0 and any(i in near[s] for s in seeds)]
    heapq.heapify(queue)
    while queue:
        _, i, k = heapq.heappop(queue)
        if label[i] < 0:
            label[i] = k
            members[k] += 1
            means[k] += (features[i] - means[k]) / members[k]
            for j in near[i]:
                if label[j] < 0:
                    heapq.heappush(queue, entry(j, {label[m] for m in near[j] if label[m] >= 0}))
    for i in range(len(xy)):
        if label[i] < 0:
            label[i] = max(range(3), key=lambda k: (like(i, k), -k))
    return label, size


def layouts():
    r = np.random.default_rng(3)
    grid = np.array([(512.0 * (i % 40), 512.0 * (i // 40)) for i in range(1500)])
    yield grid, r.normal(size=(1500, 16)).astype(np.float32)
    yield grid[r.random(1500) < 0.6], None
    yield np.concatenate([grid[:60], grid[:60] + 90_000]), None  # two islands: one has no seed
    yield r.random((300, 2)) * 4000, None
    yield np.repeat(grid[:5], 3, axis=0), None  # patches on top of each other
    yield np.zeros((6, 2)), None  # seeds that coincide
    yield grid[:48], np.repeat(r.integers(-1, 2, (4, 3)), 12, axis=0).astype(np.float32)  # equal features, zeros among them
    yield grid[:1].repeat(1, axis=0) + [[0, 0], [0, 7], [0, 3], [0, 1]], None


@pytest.mark.parametrize("k", range(8))
def test_growth_as_the_plain_one(k):
    xy, features = list(layouts())[k]
    features = np.random.default_rng(k).normal(size=(len(xy), 5)) if features is None else features
    want, size = plain_grow(xy, features)
    got, own = regions.grow(xy, features)
    assert got.tolist() == want and own == pytest.approx(size)


def test_least_distance_and_cells():
    r = np.random.default_rng(0)
    for t in range(200):
        xy = r.integers(0, r.integers(2, 300), (r.integers(2, 60), 2)).astype(float) if t % 2 else r.random((r.integers(2, 60), 2)) * 1000
        size, near = plain_near(xy)
        assert regions.patch_size(xy) == pytest.approx(size)
        cells = regions._Cells(xy, 1.42 * size)
        assert [sorted(cells.near(i).tolist()) for i in range(len(xy))] == near
    line = np.stack([np.zeros(200_000), np.arange(200_000) * 3.0], axis=1)  # one column: a sweep over x compares all
    assert regions.least_distance(line) == 3.0 and regions.least_distance(line[:1]) == np.inf


def brute_distance(mask):
    clear, cells = np.argwhere(~mask), np.argwhere(mask)
    return ((cells[:, None] - clear[None]) ** 2).sum(axis=-1).min(axis=1) if len(clear) else np.full(len(cells), max(mask.shape) ** 2)


def test_distances():
    r = np.random.default_rng(1)
    for _ in range(300):
        mask = r.random((r.integers(1, 15), r.integers(1, 15))) < r.choice([0.3, 0.7, 0.9, 0.98, 1])
        if mask.any():
            assert (regions.squared_distances(np.argwhere(mask), mask.shape) == brute_distance(mask)).all()
    one = np.ones((600, 700), bool)
    one[7, 3] = False
    cells = np.argwhere(one)
    assert (regions.squared_distances(cells, one.shape) == ((cells - [7, 3]) ** 2).sum(axis=1)).all()
    far = np.array([[0, 0], [10**7, 5], [10**7, 6], [10**9, 10**9]])  # a grid that no memory holds
    assert regions.squared_distances(far, (10**9 + 1, 10**9 + 1)).tolist() == [1, 1, 1, 1]
    assert regions.inscribed_circle(np.array([[2, 2], [2, 1], [1, 1], [2, 2]]), (5, 5)) == (1.0, 1, 1)


def test_slides_of_any_size_and_name(spark):
    r = random.Random(2)
    sizes = {"a": 400, "b": 3, "c": 4, None: 30, "d": 900}
    rows = [(s, i, 10.0 * (i % 20), 10.0 * (i // 20), [r.gauss(0, 1) for _ in range(6)]) for s, n in sizes.items() for i in range(n)]
    r.shuffle(rows)
    patches = spark.createDataFrame(rows, "slide_id string, patch_idx int, x double, y double, feature array<float>").selectExpr("*", "'x' as cluster", "1 as label").repartition(5)
    got = regions.grow_regions(patches)
    labels = {(x.slide_id, x.patch_idx): x.cluster for x in got.collect()}
    assert len(labels) == 400 + 4 + 30 + 900
    for s in ("a", "c", None, "d"):
        own = sorted(x for x in rows if x[0] == s)
        want, _ = plain_grow(np.array([x[2:4] for x in own]), np.array([x[4] for x in own], np.float32))
        assert [labels[s, x[1]] for x in own] == want
    whole = {(x.slide_id, x.patch_idx): x.cluster for x in regions.grow_regions(patches.repartition(1)).collect()}
    assert whole == labels
    circles = regions.circles(patches, got).collect()
    assert sum(c["count"] for c in circles) == 400 + 4 + 900 and regions.grow_regions(patches.where("false")).count() == 0


def test_runs_over_batches():
    ids = ["a", "a", "b", None, None, "c", "c", "c"]
    for n in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + n], pa.string())], ["slide_id"]) for i in range(0, len(ids), n)]
        assert [(s, sum(p.num_rows for p in parts)) for s, parts in regions._runs(iter([batches[0].slice(0, 0), *batches]))] == [("a", 2), ("b", 1), (None, 2), ("c", 3)]
