"""The audit against a plain count over every order."""

import collections
import re
from itertools import permutations

from slideqa.llm import filter_audit as audit

WORD = r"[^\x20\x09-\x0D]+"


def plain(docs, labels):
    texts = collections.defaultdict(list)
    for d, t, *_ in docs:
        if d is not None:
            texts[t or ""].append(d)
    fails = []
    for d, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(WORD, t)
        bad = {k for k, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t))), strict=True) if x}
        bad |= {"E"} if d is not None and min(texts[t]) < d else set()
        fails.append((lang or "", bad, any(x == d and q == 1 for x, q, _ in labels if x is not None), any(x == d and y == 1 for x, _, y in labels if x is not None)))
    out, shapley = {}, collections.Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            for part, bad, good, toxic in fails:
                n = out.setdefault((part, order, step), [0] * 6)
                gone = bad & set(order[: step - 1])
                here = f in bad and not gone
                for i, x in enumerate((not gone and f not in bad, here, f in bad and bool(gone), bad == {f}, here and good, here and toxic)):
                    n[i] += x
                shapley[part, f] += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(df):
    got = [((r.part, r.filter_order, r.step), (*(r[c] for c in audit.COUNTS), r.shapley)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_filter_audit(spark, edge_docs, edge_rows, no_docs):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(0, 1, 1), (None, 1, 1), (4, None, None), (999, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part", "2 as mask", "3 as digest")
    clash = edge_docs.selectExpr("*", "'x' as part", "1 as mask", "2 as good", "3 as steps", "4 as quality")
    got = rows(audit.filter_audit(clash, marks))
    assert got == plain(edge_rows, labels)
    assert {p for p, *_ in got} == {"en", "de", "zz", ""} and any(v[2] for v in got.values()) and any(v[4] for v in got.values())
    assert rows(audit.filter_audit(clash, marks.where("false"))) == plain(edge_rows, [])
    assert audit.filter_audit(no_docs, marks).count() == 0


def test_copies_long_words_and_spaces(spark):
    texts = ["copy of a text"] * 40 + ["word " * 250, " " + "w" * 200_000, "\x0b".join(map(str, range(300))), "\x0ba\x1cb\x0c", "A" * 4 + "a" * 96, "AAA" + "é" * 97]
    docs = [(i % 43, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    assert rows(audit.filter_audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == plain(docs, [])


def test_every_order_once():
    assert len(set(audit.orders())) == 120 and all(sorted(o) == list("ABCDE") for o in audit.orders())
