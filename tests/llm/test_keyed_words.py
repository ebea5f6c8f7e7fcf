"""Words made to have equal public hashes are different words to operators 2, 4, 8 and 10."""

import math

import numpy as np
import pyarrow as pa
import pytest

from slideqa.llm import class_lm, licenses, near_dup, quality, text
from slideqa.llm.text import flat, words

ONE, TWO = "abcdefghijklmnop", "jymmjsjh5+lv*@]}"


def test_made_words():
    public = words(*flat(pa.array([f"{ONE} {TWO} license gsrmuogm3xkwf8yc"])))
    assert public.hash[0] == public.hash[1] and public.hash[2] == public.hash[3]
    keyed = words(*flat(pa.array([f"{ONE} {TWO} license gsrmuogm3xkwf8yc {ONE} {'x' * 300}"])), keyed=True)
    assert len(set(keyed.hash.tolist())) == 5 and keyed.hash[0] == keyed.hash[4]


def test_near_duplicates(spark):
    rows = [(1, ONE), (2, TWO), (3, f"{ONE} b c d e f g"), (4, f"{TWO} b c d e f g"), (5, ONE.upper())]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_repeats(spark):
    rows = [(1, f"{ONE} c d e f g h {TWO} c d e f"), (2, f"{ONE} c d e f g h {ONE} c d e f")]
    got = {r.doc_id: r.n_repeat_words for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 10}


def test_class_model(spark):
    """Training holds only the first word; the key follows the training texts, not the order of rows or other texts."""
    rows = [(i, ONE if i else f"{ONE} b") for i in range(20)] + [(20 + i, TWO) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").where(f"{'text not like ' + repr(TWO[:8] + '%')} or crc32(cast(doc_id as string)) % 5 = 1")
    got = class_lm.scores(docs, keyed=True).collect()
    train = [r for r in got if not r.held_out]
    assert all(r.n_known == 2 for r in train if r.doc_id) and any(r.doc_id >= 20 for r in got)
    n, kinds = sum(r.n_tokens for r in train), 2 + any(r.doc_id == 0 for r in train)
    for r in got:
        if r.doc_id >= 20:
            want = math.log10(0.5) + math.log10(len(train) + 0.5) - 2 * math.log10(n + 0.5 * (kinds + 1))
            assert r.held_out and r.n_known == 1 and math.isclose(r.base_score, want, abs_tol=1e-9)
    texts = docs.select("text")
    key = class_lm.text_key(texts)
    assert key == class_lm.text_key(texts.repartition(3).orderBy(texts.text.desc())) and len(key) == 16
    assert len({key, class_lm.text_key(texts.limit(3)), class_lm.text_key(texts.where("false"))}) == 3
    more = docs.unionByName(spark.createDataFrame([(i, "any other text") for i in range(200)], docs.schema).where("crc32(cast(doc_id as string)) % 5 = 1"))
    again = {(r.doc_id, r.n_tokens): r.score for r in class_lm.scores(more, keyed=True).collect()}
    assert all(math.isclose(again[r.doc_id, r.n_tokens], r.score, abs_tol=1e-9) for r in got)


def test_phrases(spark):
    rows = [(1, "under the mit gsrmuogm3xkwf8yc"), (2, "under the mit license")]
    got = {r.doc_id: (r.n_base, r.labels) for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string"), wrapped=True).collect()}
    assert got == {1: (0, []), 2: (1, ["mit"])}


def test_tasks_have_the_drivers_key(spark):
    def bare(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(words(*flat(pa.array(["a"])), keyed=True).hash.view(np.int64)[0])] * b.num_rows)], ["h"])

    own = int(words(*flat(pa.array(["a"])), keyed=True).hash.view(np.int64)[0])
    assert {r.h for r in spark.range(8, numPartitions=4).mapInArrow(text.lean(bare), "h long").collect()} == {own}
    with pytest.raises(RuntimeError):
        import unittest.mock as mock

        with mock.patch.object(text, "_secret", None), mock.patch.object(text.TaskContext, "get", lambda: 1):
            text.secret()
