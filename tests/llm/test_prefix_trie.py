"""The trie against a plain one over lists, with blocks so small that most prefixes run over several."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from slideqa.llm import prefix_trie as trie


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_sequences(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}


def plain_rebuilt(own):
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + t[h:]
    return out


def plain_trie(conversations):
    nodes = collections.defaultdict(list)
    for c, t in conversations.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children, leaves, saved = collections.Counter(p[:-1] for p in nodes if p), collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p)) for p, m in nodes.items()}
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "'x' as key", "1 as part", "2 as kind", "3 as t", "4 as at", "5 as stem")


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks(spark, seed):
    r = random.Random(seed)
    data = [(c, i, r.choice("ua"), r.choice(["x", "yy", "é", ""])) for c in r.sample(range(-300, 5000), 220) for i in range(r.randint(0, 4) + 1)]
    data += [(c, i, "u", "same") for c in range(9000, 9060) for i in range(3)] + [(9070, i, "u", "same") for i in range(60)]
    r.shuffle(data)
    df = frame(spark, data)
    for block in (2, 7, 10_000):
        assert rows(trie.prefix_trie(trie.rebuilt(df), block)) == plain_trie(plain_rebuilt(plain_sequences(data)))
    assert rows(trie.prefix_trie(trie.sequences(df), 5)) == plain_trie(plain_sequences(data))


def test_edges(spark):
    data = [(0, 1, "u", "a"), (0, None, "u", "first"), (0, 1, "u", "a"), (0, 1, None, "b"), (1, 0, "u", None), (None, 0, "u", "lost"), (107, 0, "a", "only"), (101, 5, "u", "z" * 300_000), (-5, 0, "u", "minus"), (3, None, None, None)]
    data += [(c, i, "u", "gone") for c in range(200, 240) for i in range(zlib.crc32(str(c).encode()) % 6)]
    got = rows(trie.prefix_trie(trie.rebuilt(frame(spark, data)), 3))
    assert got == plain_trie(plain_rebuilt(plain_sequences(data)))
    root = got[[r[1] for r in got].index(0)]
    assert root[2] is None and root[-1] != hashlib.sha256(b"").hexdigest()  # some conversations have no turn left
    turnless = [(c, 0, "u", "x") for c in range(301, 330) if zlib.crc32(str(c).encode()) % 6]
    assert rows(trie.prefix_trie(trie.rebuilt(frame(spark, turnless)), 4)) == plain_trie(plain_rebuilt(plain_sequences(turnless)))
    assert trie.prefix_trie(trie.rebuilt(frame(spark, data).where("false"))).count() == 0


def test_extents():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 31, 64, 100):
        values = r.integers(0, 4, n)
        levels = trie.sparse_table(values)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        right = [next((j for j in range(i + 1, n) if values[j] < d), n) for i, d in zip(at, depth, strict=True)]
        left = [next((j for j in range(i, 0, -1) if values[j] < d), 0) for i, d in zip(at, depth, strict=True)]
        assert trie.right_end(levels, at, depth).tolist() == right and trie.left_end(levels, at, depth).tolist() == left
        low, high = np.array([(a, b) for a in range(n) for b in range(a + 1, n + 1)]).T
        assert trie.range_minimum(levels, low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]
