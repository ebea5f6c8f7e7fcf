import random
import re

import numpy as np
import pyarrow as pa

from slideqa.llm import near_dup as n
from slideqa.llm.graph import components
from slideqa.llm.text import SPACED, flat, shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_tuples(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """component by doc_id; rows without doc_id stand alone."""
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingle_tuples(t))
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in ids}


def test_against_brute_force(edge_docs, edge_rows):
    want = brute(edge_rows)
    got = n.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {d: len(shingle_tuples(t)) for d, t, *_ in edge_rows if d is not None}


def test_hot_group_of_near_copies(spark):
    """Copies of one text with random edits: most are linked, many only through others, and nothing is lost."""
    r = random.Random(9)
    words_ = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        w = list(words_)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = r.choice(["p", "q", "r"])
        rows.append((i, " ".join(w)))
    want = brute(rows)
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_document_with_several_texts(spark, edge_rows):
    """A doc_id with two texts links what either is like."""
    texts = {d: t for d, t, *_ in edge_rows if d is not None}
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (2, texts[1]), (9, texts[2]), (7, texts[2]), (7, texts[8]), (8, texts[9])]
    got = {r.doc_id: r.component_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 5: 2, 2: 2, 9: 7, 7: 7, 8: 8}


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words have equal polynomial hashes modulo powers of two; they are different words here."""
    pairs = [thue_morse(k) for k in (64, 512, 1024, 2048, 4096)]
    for a, b in pairs:
        w = words(*flat(pa.array([a, b, a])), SPACED)
        assert w.hash[0] == w.hash[2] != w.hash[1] and w.check[0] == w.check[2] != w.check[1]
    rows = [(10 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    rows += [(100 + 10 * i + j, f"{t} and four more words") for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d for d, _ in rows} and {r.n_shingles for r in got} == {1}


def test_text_of_a_document_with_several(spark):
    """A set is looked up by its own text, not by a document that has another one too."""
    r = random.Random(5)
    x = [f"w{i}" for i in range(400)]
    near = x[:200] + ["edit", "edit2"] + x[202:]
    y = [f"y{r.randrange(10**6)}" for _ in range(400)]
    rows = [(5, " ".join(x)), (5, " ".join(y)), (6, " ".join(near)), (8, ""), (8, " ".join(y[:390])), (9, None)]
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(5, 396, 5), (5, 396, 5), (6, 396, 5), (8, 0, 5), (8, 386, 5), (9, 0, 9)]


def test_random_documents_with_several_texts(spark):
    r = random.Random(15)
    base = [[f"w{r.randrange(5000)}" for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(40)] = f"e{r.randrange(10**6)}"
        rows.append((r.randrange(70), r.choice([" ".join(w)] * 8 + ["", None])))
    want = brute(rows)
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(x.component_id == want[x.doc_id] for x in got)


def test_empty(no_docs):
    assert n.near_duplicates(no_docs).count() == 0


def test_words_and_shingles():
    texts = ["A b\x0bC", None, "", "Éa é b", "one two three four five six", "x" * 2_000_000 + " y", " \n"]
    data, offsets = flat(pa.array(texts))
    w = words(data, offsets, SPACED)
    found = [[data[s:e].tobytes().decode() for s, e in zip(w.start[w.doc == i], w.end[w.doc == i], strict=True)] for i in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [len(s) for s in shingles(w, len(texts))] == [len(shingle_tuples(t)) for t in texts]
    assert n.word_shingles("A  B c d e f") == n.word_shingles("a b\nc d e F") == {tuple(x.encode() for x in t) for t in shingle_tuples("a b c d e f")}


def test_estimate():
    r = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.9):
        both = r.integers(0, 2**63, 4000, dtype=np.uint64)
        k = int(share * 4000)
        rest = (4000 - k) // 2
        a, b = np.unique(both[: k + rest]), np.unique(np.concatenate([both[:k], both[k + rest :]]))
        got, _ = n.estimate(n.registers([a]), n.registers([b]), np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - share) < 0.12


def test_intersections():
    r = np.random.default_rng(5)
    a, b = ([np.unique(r.integers(0, 300, m)).astype(np.uint64) for m in r.integers(1, 90, 20)] for _ in range(2))
    assert (n.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = brute_components([e for e in edges if None not in e and e[0] != e[1]])
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def brute_components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label
