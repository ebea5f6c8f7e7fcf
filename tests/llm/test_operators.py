"""Each operator against a plain version, on odd texts."""

import collections
import gzip
import hashlib
import json
import math
import random
import re
import string
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slideqa.llm import bpe, class_lm, decontaminate, licenses, near_dup, quality, secrets, token_file, url_filter, warc
from slideqa.llm.tables import Saved, new_path, shared_folder
from slideqa.llm.text import Words, flat, words
from slideqa.llm.word_cache import WordCache
from tests import compare
from tests.llm.test_dedup import LOWER, shingle_tuples, thue_morse

WORD = r"[^\x20\x09-\x0D]+"


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def test_decontaminate(spark, edge_docs, edge_rows, no_docs):
    texts = {d: t for d, t, *_ in edge_rows if d is not None}
    items = [(0, texts[3]), (1, " ".join(texts[0].split(" ")[5:30])), (2, None), (3, "a b"), (4, texts[4]), (5, "nowhere to be found at all here"), (5, texts[7]), (None, texts[0]), (6, texts[0] + " " + " ".join(f"z{i}" for i in range(15)))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id", "1 as gram")
    sets = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            sets[i] |= shingle_tuples((t or "").lower())
    own = collections.defaultdict(set)
    for d, t, *_ in edge_rows:
        if d is not None:
            own[d] |= shingle_tuples((t or "").lower())
    want = {(d, i): len(own[d] & s) for d in own for i, s in sets.items() if s and 100 * len(own[d] & s) >= 75 * len(s)}
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contained_items(edge_docs, bench, least_inside=decontaminate.SHINGLE).collect()}
    assert got == want and len(got) > 5
    inside = {(d, 3): 1 for d, t, *_ in edge_rows if d is not None and re.search(r"(^|\s)a\s+b(\s|$)", t or "", re.I)}
    assert inside and {(r.doc_id, r.item_id): r.n_shared for r in decontaminate.contained_items(edge_docs, bench).collect()} == want | inside
    clean = decontaminate.clean_documents(edge_docs, bench)
    hit, nameless = {d for d, _ in want}, lambda t: any(s and 100 * len(shingle_tuples((t or "").lower()) & s) >= 75 * len(s) for s in sets.values())
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t, *_ in edge_rows if d not in hit and (d is not None or not nameless(t)))
    leak = spark.createDataFrame([(None, texts[0]), (None, None), (None, "nothing of that kind is in here")], "doc_id long, text string")
    assert [r.text for r in decontaminate.clean_documents(leak, bench).orderBy("text").collect()] == [None, "nothing of that kind is in here"]
    assert clean.columns == edge_docs.columns
    assert decontaminate.contained_items(no_docs, bench).count() == 0 and decontaminate.contained_items(edge_docs, bench.where("false")).count() == 0


def test_items_of_few_words_inside_documents(spark, edge_rows, tmp_path):
    """Items of one to four words, at either end, repeated, over line ends; against a plain search and the SQL."""
    long = next(t for d, t, *_ in edge_rows if t and len(t.split()) > 5000).split()
    items = [(i, " ".join(long[at : at + n])) for i, (at, n) in enumerate([(0, 4), (len(long) - 3, 3), (4000, 2), (77, 4)])]
    items += [(10, "Only\tHere\n now"), (11, "zeta"), (12, "zeta zeta"), (13, "not there"), (14, ""), (15, None), (16, "a b c d e"), (17, "É d'été")]
    texts = [" ".join(long), "x only here\n\nnow y z", "only here", "zeta", "zeta zeta zeta", "pre zeta post and more words", "a b c d", "a b c d e f", "été é D'ÉTÉ fin de la", None, "", "only there now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(least):
        found = set()
        for d, t in enumerate(texts):
            w = re.findall(WORD, (t or "").lower())
            for i, q in items:
                own = re.findall(WORD, (q or "").lower())
                inside = len(own) >= least and any(w[k : k + len(own)] == own for k in range(len(w) - len(own) + 1))
                if own and (inside or w == own):
                    found.add((d, i))
        return found

    for least in (1, 3, 5):
        got = decontaminate.contained_items(docs, bench, least_inside=least).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert pairs == plain(least) | {(7, 16)} and len(got) == len(pairs) and all(r.n_item == r.n_shared == 1 for r in got)
    assert {(0, 0), (0, 1), (0, 2), (0, 3), (1, 10), (3, 11), (4, 12), (5, 11), (8, 17)} <= plain(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare.rows(decontaminate.op1_decontaminate(spark, str(tmp_path)).toPandas()) == compare.rows(db.execute(decontaminate.OP1_SQL).df())
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in plain(decontaminate.LEAST_INSIDE)} - {7} and {5, 8} <= kept


@pytest.mark.parametrize("item", ["a b c d e f g", "a b c"])
def test_decontaminate_is_native(spark, edge_docs, item):
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    plan = decontaminate.contained_items(edge_docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def fits(host, path, rule):
    h, p, _ = rule
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_urls(spark):
    r = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xexample.com", "net", "x.net", "", "EXAMPLE.com:80", "a..com", ".com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/é?q=/fr/", "/fr/#a", "?x", "/en\n/"]
    urls = [None, "", "no scheme", "://", "http://"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    rules = [*url_filter.RULES, ("a.example.com", "/e", "allow"), ("a.example.com", "/en/", "allow"), ("a.example.com", "/en/", "block"), ("example.com", "", "block"), (None, "/", "allow")]
    pages = spark.createDataFrame([(i // 2, u, "h") for i, u in enumerate(urls + urls[:7])], "page_id long, url string, host string")
    out = url_filter.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(out) == len(urls) + 7
    for x in out:
        met = {(h, p, "block" if (h, p, "block") in rules else a) for h, p, a in rules if h is not None and fits(x.host, x.path, (h, p, a))}
        best = max(met, key=lambda m: (len(m[0] + m[1]), len(m[0])), default=(None, None, "allow"))
        assert (x.rule, x.verdict) == (best[0] + best[1] if met else None, best[2])
    rule_rows = spark.createDataFrame(rules, "host string, path string, action string")
    for hot in (1, 40):  # no url is broadcast, some are
        assert sorted(url_filter.url_verdicts(pages, rule_rows, hot=hot).collect(), key=str) == sorted(out, key=str)
    assert url_filter.url_verdicts(pages.where("false"), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    assert {x.verdict for x in url_filter.url_verdicts(pages, spark.createDataFrame([], "host string, path string, action string")).collect()} == {"allow"}


def test_shared_and_very_long_urls(spark):
    """Front pages that most rows share, pages without a host, and a url of a megabyte."""
    long = "http://WWW.example.com/en/" + "a/" * 500_000
    urls = ["http://a.net/"] * 60 + ["http://b.com/"] * 50 + [None, "no"] * 40 + [long, "http://x.net/fr/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    want = {"http://a.net/": (None, "allow"), "http://b.com/": ("com/", "allow"), None: (None, "allow"), "no": (None, "allow"), long: ("www.example.com/en/", "allow"), "http://x.net/fr/1": ("net/fr/", "block")}
    for hot in (1, 10, url_filter.HOT):
        got = {x.page_id: x for x in url_filter.url_verdicts(pages, rules, hot=hot).collect()}
        assert {i: (x.rule, x.verdict) for i, x in got.items()} == {i: want[u] for i, u in enumerate(urls)}
        assert got[len(urls) - 2].path == long[len("http://www.example.com") :]


def brute_quality(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "[#*$%&|<>]"[1:-1] for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(edge_docs, edge_rows, no_docs):
    got = by_id(quality.judged(edge_docs).collect())
    assert sum(map(len, got.values())) == len(edge_rows)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=quality.vocabulary_path())
    for d, t, *_ in edge_rows:
        if d is not None:
            r = got[d][0]
            want = brute_quality(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
            ids = [i for w in re.findall(WORD, t or "") for i in sp.encode(w)]
            p = [c / len(ids) for c in collections.Counter(ids).values()]
            assert r.n_tokens == len(ids) and r.entropy == pytest.approx(-sum(x * math.log2(x) for x in p), abs=1e-9)
    without = quality.good_documents(edge_docs.drop("lang"))
    assert "lang" not in without.columns and without.count() > 3
    kept = quality.good_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(r.kept for rs in got.values() for r in rs)
    assert quality.judged(no_docs).count() == 0 and quality.good_documents(no_docs).count() == 0


def test_other_vocabulary(spark, edge_docs, edge_rows):
    """The same measures by a tiktoken vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode, single = quality._encoder(path)
    got = by_id(quality.judged(edge_docs, path=path).collect())
    for d, t, *_ in edge_rows[:30]:
        ids = [i for w in encode(re.findall(WORD, t or "")) for i in w]
        assert got[d][0].n_tokens == len(ids) and got[d][0].byte_share == pytest.approx(single[ids].mean() if ids else 0)
    assert quality._encoder(quality.vocabulary_path())[1].nonzero()[0].tolist() == list(range(3, 259))


def test_fitted_curves(spark):
    r = random.Random(3)
    rows = [(lang, n, a * math.log2(n) ** 2 + b * math.log2(n) + c) for lang, (a, b, c) in {"en": (-0.05, 1.1, 0.2), "xx": (-0.02, 0.9, 0.5)}.items() for n in r.sample(range(60, 5000), 50)]
    got = quality.fitted_curves(spark.createDataFrame([*rows, ("one", 100, 5.0), ("en", 10, 99.0)], "lang string, n_tokens long, entropy double"))
    assert got["en"] == pytest.approx((-0.05, 1.1, 0.2), abs=1e-6) and got["xx"] == pytest.approx((-0.02, 0.9, 0.5), abs=1e-6) and set(got) == {"en", "xx"}


def brute_spans(text):
    out = [(*m.span(), 0) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secret_patterns():
    r = random.Random(6)
    bits = ["password", "PassWd", "token", "api_key", "APIkey", "secret", "=", ": ", " = ", '"', "'", "abc123def456", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "é", "\n", " ", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(800)]
    for t, (spans, _) in zip(texts, secrets.scanned(pa.array(texts)), strict=True):
        assert spans == brute_spans(t)


def test_secrets(edge_docs, edge_rows, no_docs):
    got = by_id(secrets.secret_spans(edge_docs).collect())
    assert sum(map(len, got.values())) == len(edge_rows)
    kinds = {k: i for i, k in enumerate(secrets.KINDS)}
    for d, t, *_ in edge_rows:
        if d is not None:
            base = [(s.start, s.end, kinds[s.kind]) for s in got[d][0].spans if s.kind != "cnn"]
            assert base == brute_spans(t or "")
    clean = {r.doc_id: r.text for r in secrets.redacted_documents(edge_docs).collect()}
    dirty = next(d for d, t, *_ in edge_rows if t and "AKIA" in t)
    assert "AKIA" not in clean[dirty] and "deadbeef" not in clean[dirty] and secrets.PLACEHOLDER in clean[dirty]
    assert clean[0] == edge_rows[0][1] and clean[11] == ""
    assert secrets.secret_spans(no_docs).count() == 0 and secrets.redacted_documents(no_docs).count() == 0


def test_network_learns():
    windows, labels = secrets.made_findings(400, 1)
    more, known = secrets.made_findings(150, 2)
    net = secrets.trained(windows, labels)
    taken = secrets.probabilities(net, more) >= net.threshold
    known = np.array(known)
    assert taken[known].mean() > 0.9 and taken[~known].mean() < 0.1
    assert net.recall > 0.9


def test_secrets_that_patterns_lack(spark):
    """Secrets with few digits are judged, and what no pattern found isn't taught as harmless."""
    r = random.Random(12)
    letters = string.ascii_letters
    made = ["".join(r.choice(letters) for _ in range(24)) for _ in range(100)] + ["ghp_" + "".join(r.choice(letters + string.digits) for _ in range(36)) for _ in range(1600)]
    words = ["responsibilities", "Verantwortlichkeit", "internationalization", "gouvernementales", "INCOMPREHENSIBLE", "establecimiento"]
    docs = spark.createDataFrame([(i, f"the key is {x} of it") for i, x in enumerate(made)] + [(9000 + i, f"on the {x} of it") for i, x in enumerate(words)], "doc_id long, text string")
    got = {d: rs[0].spans for d, rs in by_id(secrets.secret_spans(docs).collect()).items()}
    found = [any((s.start, s.end) == (11, 11 + len(x)) for s in got[i]) for i, x in enumerate(made)]
    assert sum(found[:100]) >= 90 and sum(found[100:]) >= 1440
    assert sum(bool(got[9000 + i]) for i in range(len(words))) <= 1


def test_secrets_behind_long_names(spark):
    """A secret at the end of a long run is seen, with what stands around it; a long run without one is left alone."""
    r = random.Random(14)
    fronts = ["some/long/directory/name/of/configuration/", "EXPORTED_DATABASE_CONNECTION_CREDENTIAL_OF_PRODUCTION="]
    value = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32))
    rows = [(i, f"on é {fronts[i % 2]}{value()} of") for i in range(100)]
    rows += [(1000 + i, f"on é {f[:-1]} of") for i, f in enumerate(fronts)]
    got = {d: rs[0].spans for d, rs in by_id(secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()).items()}
    assert sum(any(s.start == 5 and s.end == len(t) - 3 for s in got[d]) for d, t in rows[:100]) >= 90
    assert not got[1000] and not got[1001]
    for size in (12, 36, 37, 54, 55, 500):
        run = value() * 20
        (_, [(start, end, every, known, within)]) = next(secrets.scanned(pa.array(["é " + run[:size] + " end"])))
        parts = [every[i : i + secrets.WIDTH] for i in range(0, len(every), secrets.WIDTH)]
        assert (start, end, known, len(within)) == (2, 2 + size, False, len(parts))
        assert parts[0].lstrip(b"\0").startswith("é ".encode()) and parts[-1].rstrip(b"\0").endswith(b" end")
        assert all(any(run[i : min(size, i + 18)].encode() in p[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] for p in parts) for i in range(size))


def test_missed_secrets_lower_the_threshold():
    windows, labels = secrets.made_findings(200, 1)
    assert secrets.trained(windows, labels, epochs=2, missed=20).threshold < secrets.trained(windows, labels, epochs=2).threshold


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(*bpe.paths())


def test_tree_concatenation(coder):
    r = random.Random(8)
    alphabet = ["a", "b", "the", "'s", "'ll", " ", "  ", "\n", "é", "ß", "中", "1", "23", "!", "'", "\t", bpe.END, "😀", "aaa", "\x1c", " "]
    for _ in range(1500):
        pool = r.sample(alphabet, r.randint(1, 6))
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 300)))
        ids = coder.encode(text, leaf=r.choice([7, 16, 33, 64]))
        assert ids.tolist() == coder.slow.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text


def test_bpe(spark, edge_docs, edge_rows, coder, no_docs):
    rows = bpe.decoded(bpe.encoded(edge_docs, leaf=500, segment=4000)).collect()
    assert len(rows) == len(edge_rows)
    got = by_id(rows)
    for d, t, *_ in edge_rows:
        if d is not None:
            want = coder.slow.encode(t or "", add_special_tokens=False)
            assert np.frombuffer(got[d][0].ids, "<u4").tolist() == want.ids and got[d][0].text == (t or "")
    twice = spark.createDataFrame([(1, "ab " * 9000), (1, "ab " * 9000), (2, "ab " * 9000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in bpe.encoded(twice, segment=4000).collect()) == [1, 1, 2]
    assert bpe.decoded(bpe.encoded(no_docs)).count() == 0


def test_warc(spark):
    big, other = "<p>" + "x" * 1200, "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a\r\n/4", other), (5, "u", ""), (6, "u", None), (7, "u", "short"), (8, "u", "short"), (9, "u", other), (9, "u", other), (9, "v", "WARC/1.1\r\n\r\n" * 200), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'x' as copy", "1 as record_id")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    assert records.count() == 3 * len(rows)
    kinds = {r.record_id: r.kind for r in records.collect()}
    refers = [r.refers_to for r in records.where("kind = 'revisit'").collect()]
    assert len(kinds) == 3 * len(rows) and len(refers) == 4 and {kinds[r] for r in refers} == {"response"}
    got = warc.captures(records).collect()
    assert len(got) == len(rows)
    for p, _, html in rows:
        body = (html or "").encode()
        same = [q for q, _, h in rows if h == html and q is not None]
        top = max(same) if len(body) >= 1000 and sum(h == html for *_, h in rows) > 1 else None
        mine = [r for r in got if r.page_id == p and r.payload_digest == hashlib.sha1(body).hexdigest()]
        assert mine and all(r.payload_bytes == len(body) for r in mine)
        kind = "response" if top is None or p == top else "revisit"
        assert all((r.record_type, r.refers_to) == (kind, top if kind == "revisit" else None) for r in mine)
        assert all(r.request is not None and r.metadata is not None for r in mine)
    path = new_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path, archive=1500)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 3
    for f in files:  # plain gzip of whole records, each a member that can be read alone
        every = list(warc.members(memoryview(f.content)))
        assert gzip.decompress(f.content) == b"".join(every) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in every)
        assert len(f.content) <= 1501 or len(every) == 1
    again = warc.captures(warc.read_warc(spark, path), payload=False).drop("response")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    key = lambda r: str([r[c] for c in columns])
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(memoryview(files[0].content[:100])))
    path = new_path(spark, "warc")
    warc.write_warc(pages.where("false"), path)
    assert warc.captures(warc.read_warc(spark, path)).count() == 0


def test_warc_of_very_long_pages(spark):
    """Pages of tens of megabytes stay whole, each in a file of its own."""
    pages = spark.range(3).selectExpr("id as page_id", "'http://h/' as url", "repeat(sha2(cast(id as string), 512), 160000) as html")
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.captures(warc.read_warc(spark, path), payload=False).collect()}
    assert got == {i: (128 * 160_000, hashlib.sha1(hashlib.sha512(str(i).encode()).hexdigest().encode() * 160_000).hexdigest()) for i in range(3)}


def test_class_model(edge_docs, edge_rows, no_docs):
    got = class_lm.scores(edge_docs, clustered_words=40, lookup=25).collect()
    assert len(got) == len(edge_rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    sets = [(d, [*re.findall(WORD, (t or "").translate(LOWER)), "\n"]) for d, t, *_ in edge_rows]
    counts = collections.Counter(w for d, ws in sets if not held(d) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6)) for d, ws in sets)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert class_lm.scores(no_docs).count() == 0


def test_exchange_gain():
    """The gain of a move is the change of the likelihood that it makes."""
    r = np.random.default_rng(3)
    n, k = 30, class_lm.CLASSES + class_lm.RARE + 1
    pairs = r.integers(0, n, (4000, 2))
    classes = np.concatenate([r.integers(0, class_lm.CLASSES, n), class_lm.CLASSES + np.arange(class_lm.RARE + 1)])
    table = collections.Counter(map(tuple, pairs.tolist()))

    def matrix(c):
        m = np.zeros((k, k))
        for (v, w), x in table.items():
            m[c[v], c[w]] += x
        return m

    m = matrix(classes)
    for w in range(8):
        left, right = np.zeros(k), np.zeros(k)
        for (a, b), x in table.items():
            left[classes[a]] += x * (b == w)
            right[classes[b]] += x * (a == w)
        to, gain = class_lm.best_class(int(classes[w]), left, right, float(table[(w, w)]), m, class_lm.CLASSES)
        moved = classes.copy()
        moved[w] = to
        assert gain == pytest.approx(class_lm.likelihood(matrix(moved)) - class_lm.likelihood(m), abs=1e-6)


def test_exchange_converges(spark):
    """The likelihood never falls, and where it ended no further turn would raise it by the stated share."""
    r = random.Random(11)
    texts = [" ".join(r.choice(["a", "b", "c"]) + str(r.randrange(60)) for _ in range(80)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text")
    counts = Saved(docs.mapInArrow(class_lm._counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    model = class_lm.trained(docs, counts.df, clustered_words=100, lookup=50)
    v = model.likelihoods
    assert len(model.vocabulary.hashes) == 100 and all(b >= a for a, b in zip(v, v[1:], strict=False)) and len(v) > 3
    assert v[-1] - v[-1 - class_lm.PARTS] < class_lm.SHARE * abs(v[-1])


def test_class_score_against_plain_version(spark):
    """Score of each text from the model's classes and plain counts, token by token."""
    r = random.Random(13)
    texts = [" ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.randrange(0, 40))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in class_lm.scores(rows, clustered_words=12, lookup=8).collect()}
    train = [t for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 5 != 1]
    docs = rows.where(~class_lm.held_out(F.col("doc_id"))).select("text")
    counts = Saved(docs.mapInArrow(class_lm._counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    model = class_lm.trained(docs, counts.df, clustered_words=12, lookup=8)
    words_of = lambda w: int(words(*flat(pa.array([w]))).hash.view(np.int64)[0])
    every = collections.Counter(w for t in train for w in [*t.split(), None])
    table = {x["h"]: (x["n"], x["class"]) for x in model.of.df.collect()}
    assert {words_of(w): n for w, n in every.items() if w} == {h: n for h, (n, _) in table.items()}
    of = {w: class_lm.END if w is None else table[words_of(w)][1] for w in every}
    k = class_lm.CLASSES + 1
    m, tokens, kinds = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in train:
        seq = [None, *t.split(), None]
        for a, b in zip(seq, seq[1:], strict=False):
            m[of[a], of[b]] += 1
    for w, n in every.items():
        tokens[of[w]] += n
        kinds[of[w]] += 1
    prior = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * k)
    emitted = lambda c, n: (n + 0.5) / (tokens[c] + 0.5 * (kinds[c] + 1))

    def chance(a, b):
        follows = lambda c: (m[of[a], c] + class_lm.PRIOR * k * prior[c]) / (m[of[a]].sum() + class_lm.PRIOR * k) if a in of else prior[c]
        return follows(of[b]) * emitted(of[b], every[b]) if b in of else sum(follows(c) * emitted(c, 0) for c in range(class_lm.CLASSES))

    assert any(w not in of for t in texts for w in t.split())
    for d, t in enumerate(texts):
        seq = [None, *t.split(), None]
        assert got[d] == pytest.approx(sum(math.log10(chance(a, b)) for a, b in zip(seq, seq[1:], strict=False)), abs=1e-6)


def test_words_outside_the_exchange_are_placed(spark):
    """Words go to the class of those that stand where they stand, by a plain count of the gains."""
    r = np.random.default_rng(4)
    k = class_lm.CLASSES + class_lm.RARE + 1
    m = r.integers(0, 50, (k, k)).astype(float)
    around = r.integers(0, 4, (20, 2 * k)).astype(float)
    around[:, k:] *= (around[:, :k].sum(axis=1) / around[:, k:].sum(axis=1))[:, None]
    for row, got in zip(around, class_lm.placed(around, m), strict=True):
        gains = [
            sum(row[x] * math.log((m[x, c] + 0.5) / (m[:, c].sum() + 0.5 * k)) + row[k + x] * math.log((m[c, x] + 0.5) / (m[c].sum() + 0.5 * k)) for x in range(k))
            for c in range(class_lm.CLASSES)
        ]
        assert gains[got] == pytest.approx(max(gains))
    rng = random.Random(2)
    classes = [[f"{c}{i}" for i in range(8)] for c in "abc"]
    texts = [" ".join(rng.choice(classes[(s + i) % 3]) for i in range(60)) for s in (rng.randrange(3) for _ in range(200))]
    out = class_lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), clustered_words=12, lookup=15).where("held_out")
    base, score = out.selectExpr("sum(base_score)", "sum(score)").first()
    assert score > 0.85 * base


def test_class_model_beats_unigrams(spark):
    """Held-out texts of a made language with classes score better than by word frequencies."""
    r = random.Random(2)
    classes = [[f"{c}{i}" for i in range(8)] for c in "abc"]
    texts = [" ".join(r.choice(classes[(s + i) % 3]) for i in range(60)) for s in (r.randrange(3) for _ in range(200))]
    out = class_lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out")
    base, score = out.selectExpr("sum(base_score)", "sum(score)").first()
    assert score > 0.85 * base


def test_token_file(spark, edge_docs, edge_rows, no_docs):
    path = new_path(spark, "tokens")
    token_file.write_tokens(edge_docs, path, block_ids=700)
    got = sorted(token_file.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(edge_rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    slow = token_file._remembered(token_file.vocabulary_path()).encode.whole
    want = collections.defaultdict(list)
    for d, t, *_ in edge_rows:
        own = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        want[d].append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    path = new_path(spark, "tokens")
    token_file.write_tokens(no_docs, path)
    assert token_file.read_tokens(spark, path).count() == 0


def test_token_ids_of_words_that_hashes_confuse():
    """Words of equal polynomial hashes get the library's ids, and so do words that share both of ours."""
    pairs = [thue_morse(k) for k in (1024, 2048, 4096)]
    texts = [f"{a} x {b} {a[:64]} {b[:64]}" for a, b in pairs]
    slow = token_file._remembered(token_file.vocabulary_path()).encode.whole
    for batch in (texts, [b for _, b in pairs], [a for a, _ in pairs]):
        ids, sizes = token_file.text_ids(pa.array(batch), token_file.vocabulary_path())
        assert ids.tolist() == [i for t in batch for i in [*slow.encode(t, add_special_tokens=False).ids, 2]] and sizes.sum() == len(ids)
    cache = WordCache(lambda found: [[len(w), w[0]] for w in found], np.uint16)
    for words_ in ([b"ab", b"c", b"ab", b"de"], [b"de", b"x", b"c"], [b"zz"]):
        data = np.frombuffer(b" ".join(words_), np.uint8)
        end = np.cumsum([len(w) + 1 for w in words_]) - 1
        start = end - [len(w) for w in words_]
        for h in (np.zeros(len(words_), np.uint64), np.frombuffer(b"".join(w.ljust(8) for w in words_), np.uint64)):
            pool, sizes, which = cache.tokens(data, Words(h, np.zeros(len(h), np.int64), start, end, h))
            first = np.cumsum(sizes) - sizes
            assert [pool[first[k] : first[k] + sizes[k]].tolist() for k in which] == [[len(w), w[0]] for w in words_]


def test_random_access():
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 300, 5000), r.integers(0, 2**20, 3000), [0, 255, 256, 2**31]]).astype(np.uint32)
    one = token_file.Block(memoryview(token_file.block(3, 9, [5, None], np.array([8000, 4]), ids)))
    assert one.doc_ids == [5, None] and (one.shard, one.before) == (3, 9)
    assert all(one.token(i) == ids[i] for i in [*range(0, len(ids), 37), len(ids) - 1])
    for a, b in ((0, len(ids)), (511, 514), (4999, 7777), (8, 8)):
        assert (one.tokens(a, b) == ids[a:b]).all()


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base = [], set()
    for p, label in licenses.PHRASES:
        q = p.split(" ")
        found = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        places += found
        base |= {label} if found else set()
    labels, best = set(base), 0.0
    for line in (text or "").translate(LOWER).split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for t, label in licenses.TEMPLATES:
            words = set(t.split(" "))
            share = len(words & own) / len(words)
            if len(words & own) >= math.ceil(licenses.THRESHOLD * len(words) - 1e-9):
                labels.add(label)
                best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), 1.0 if places else best


def test_licenses(spark, edge_docs, edge_rows, no_docs):
    got = by_id(licenses.license_labels(edge_docs).collect())
    assert sum(map(len, got.values())) == len(edge_rows)
    for d, t, *_ in edge_rows:
        if d is not None:
            assert tuple(got[d][0])[1:] == brute_licenses(t)
    r = random.Random(7)
    vocabulary = " ".join(t for t, _ in licenses.TEMPLATES).split(" ")
    rows = []
    for i in range(300):
        t = r.choice(licenses.TEMPLATES)[0].split(" ")
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice([*vocabulary, "\n", "other"])
        r.shuffle(t)
        rows.append((i, " ".join(t)))
    got = by_id(licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for d, t in rows:
        assert tuple(got[d][0])[1:] == brute_licenses(t)
    assert licenses.license_labels(no_docs).count() == 0


def test_wrapped_licenses(spark, tmp_path):
    """Notices that lines are wrapped in: every run of words is a block, wherever lines end."""
    r = random.Random(9)
    vocabulary = sorted({w for t, _ in licenses.TEMPLATES for w in t.split(" ")})
    rows = [(i, "x " * i + "\n# ".join(textwrap.wrap(t, 30)) + " y" * i) for i, (t, _) in enumerate(licenses.TEMPLATES)]
    for i in range(300):
        t = [w for _ in range(2) for w in r.choice(licenses.TEMPLATES)[0].split(" ")]
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = r.choice([*vocabulary, "other"])
            t.insert(r.randrange(len(t)), r.choice(["other", "the", "of"]))
        rows.append((100 + i, "".join(w + r.choice(" \n") for w in t)))
    rows += [(500, "released under the"), (501, "mit license"), (502, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = licenses.op10_licenses(spark, str(tmp_path))
    want = duckdb.sql(licenses.OP10_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).df()
    assert sorted(found.columns) == sorted(want.columns) and compare.rows(found.toPandas()) == compare.rows(want)
    got = by_id(found.collect())
    for d, text in rows:
        *plain, labels, score = brute_licenses(text)
        w, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)), set(labels)
        for t, label in licenses.TEMPLATES:
            words, size = set(t.split(" ")), math.ceil(len(t.split(" ")) / licenses.THRESHOLD - 1e-9)
            best = max((len(words & set(w[i : i + size])) for i in range(len(w))), default=0)
            if best >= math.ceil(licenses.THRESHOLD * len(words) - 1e-9):
                labels.add(label)
                score = max(score, best / len(words))
        assert tuple(got[d][0])[1:] == (*plain[:-1], ",".join(plain[-1]), ",".join(sorted(labels)), score)
        assert d >= 100 or licenses.TEMPLATES[d][1] in labels


def test_shared_folder(spark):
    """Without spark.checkpoint.dir a cluster has no folder that all machines see."""

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Context.master = "local[4]"
    assert shared_folder(Session).startswith("file:")
    Session.conf = {"spark.checkpoint.dir": "hdfs://there/"}
    assert shared_folder(Session) == "hdfs://there"


def test_pipeline_on_odd_tables(spark, edge_docs, edge_rows, tmp_path):
    """Extra columns of clashing names stay up to the last stage; empty tables give empty ones; of the rows of a
    doc_id the same one stays however they are dealt."""
    import corpus_pipeline as p

    spark.createDataFrame([(0, edge_rows[8][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in p.STAGES:
        out = stage(spark, edge_docs, str(tmp_path))
        assert out.count() and (name == "bpe" or out.columns == edge_docs.columns)
        none = stage(spark, edge_docs.where("false"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
    several = spark.createDataFrame([(i % 5, f"{i} text of its own, number {i * i}", i) for i in range(40)], "doc_id long, text string, extra long")
    kept = [sorted(map(tuple, p.keep_one_of_each(spark, several.repartition(k), "").collect())) for k in (1, 7)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [0, 1, 2, 3, 4]
    nameless = spark.createDataFrame([(None, edge_rows[8][1]), (None, None)], "doc_id long, text string")
    assert [r.text for r in p.drop_benchmark(spark, nameless, str(tmp_path)).collect()] == [None]


def test_pipeline_stages(spark, edge_docs, edge_rows, tmp_path):
    """Each stage against its plain version on its own input, and the whole."""
    import corpus_pipeline as p

    texts = {d: t for d, t, *_ in edge_rows if d is not None}
    spark.createDataFrame([(0, texts[8])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(p.STAGES)
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    components = near_dup.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in components if r.doc_id is not None})
    assert kept.where("doc_id is null").count() == 2 and kept.columns == docs.columns
    clean = stages["decontamination"](spark, docs, str(tmp_path))
    want = [d for d, t, *_ in edge_rows if not 100 * len(shingle_tuples(t) & shingle_tuples(texts[8])) >= 75 * len(shingle_tuples(texts[8]))]
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, want))
    redacted = stages["secret_scan"](spark, docs, str(tmp_path))
    assert all(r.n_chars == len(r.text) for r in redacted.collect() if r.text is not None) and redacted.columns == docs.columns
    out = p.run(spark, str(tmp_path)).collect()
    assert out and all(len(r.ids) == 4 * r.n_tokens for r in out)
    assert len({json.dumps(r.doc_id) for r in out}) == len(out)
