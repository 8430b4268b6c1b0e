import re
import zlib

import pytest

from candlewick.llm import decontam, packing, quality_rules, toxicity, url_filter


def test_quality_measures(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e f", "x\ny\nx\n\n\ny # $", "the " * 40, "é" * 5 + " ok\x0bgo"]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    got = quality_rules.judge(df).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute(t) for t in texts]
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_of_long_texts_and_of_tables_with_clashing_names(spark):
    long = "lorem ipsum dolor " * 60_000
    df = spark.createDataFrame([(1, long, "a", 5), (2, "x y", "b", 6)], "doc_id long, `my text` string, __text string, measures int")
    got = {r.doc_id: r for r in quality_rules.judge(df, "my text").collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].word_chars) == (180_000, 180_000, 900_000)
    assert [(got[k]["__text"], got[k].measures) for k in (1, 2)] == [("a", 5), ("b", 6)]


URLS = [
    None, "", "no scheme.com/", "http://a.com/x", "HTTP://WWW.Example.COM/en/1?q#f", "https://example.com/en/", "https://x.example.com/de/", "http://b.net/es/1", "http://b.net/es", "ftp://b.net/fr/?/",
    "http://x.spam-farm.example.org/a", "http://notspam-farm.example.org/", "://", "http://com/", "http://c.org#://x.net/es/",
]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: x[:2])[2:] if fits else (None, None)))


@pytest.mark.parametrize("most", [10**6, 2, 1])
def test_url_rules_in_one_file_and_in_many(spark, most):
    rules = [*url_filter.RULES, *((h, "", "block") for h in url_filter.BLOCKED_HOSTS)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.rule_verdict) for r in url_filter.judge(df, rules, most_rules=most).orderBy("page_id").collect()]
    assert got == [brute_url(u, rules) for u in [*URLS, *URLS]]
    assert url_filter.judge(df.limit(0), rules, most_rules=most).count() == 0
    assert {r.rule for r in url_filter.judge(df, [], most_rules=10**6).collect()} == {None}


@pytest.mark.parametrize("most", [10**6, 1])
def test_url_ties_and_long_hosts(spark, most):
    rules = [("z.com", "", "block"), ("com", "/x", "allow"), ("y.net", "/", "allow"), ("net", "/ab", "block"), ("org", "", "allow"), ("org", "", "block")]
    urls = ["http://z.com/x", "http://q.z.com/x/1", "http://y.net/ab", "http://y.net/a", "http://a.org", "http://" + "." * 40_000 + "z.com/x", "http://" + "a." * 20_000 + "net/abc" + "d" * 50_000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = [(r.rule, r.rule_verdict) for r in url_filter.judge(df, rules, most_rules=most).orderBy("page_id").collect()]
    assert got == [brute_url(u, rules[:4] + rules[5:])[2:] for u in urls]
    assert got[0] == ("z.com", "block") and got[4] == ("org", "block")
    assert len(url_filter.candidates("." * 40_000 + "z.com", "/x", [(5, 0), (3, 2), (6, 1)])) == 3


def test_windows_in_one_block_and_in_many(spark):
    items = [(1, "a b c d e f g h i j k l m"), (2, "short Item"), (3, None), (4, ""), (None, "x y"), (2, "f g h i j k l m n o p")]
    docs = [(1, "zz A b, c d e f g h i j. k l qq short item"), (2, "b c d e f g h i j"), (3, None), (4, "item short"), (5, "x y"), (6, "f g h i j k l m n o p")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, 9, "r") for d in docs], "doc_id long, text string, n_words int, row string")
    expected = [(15, [1, 13, 14, 16], ["1", "2"]), (9, [], []), (0, [], []), (2, [], []), (2, [0, 2], [None]), (11, [0, 11], ["2"])]
    expected[0] = (len("zz a b c d e f g h i j k l qq short item".split()), [1, 13, 14, 16], ["1", "2"])
    for chars in (10**6, 12):
        got = decontam.detect(df, bench, block_chars=chars).orderBy("doc_id").collect()
        assert [(r.n_words, r.hit_spans, r.hit_items) for r in got] == expected and {r.row for r in got} == {"r"}
    assert decontam.detect(df, bench.limit(0)).where("size(hit_items) > 0").count() == 0


def test_hits_equal_brute_force_on_random_texts(monkeypatch):
    import random

    random.seed(9)
    for size in (3, 12, 60):
        words = [f"w{k}" for k in range(size)]
        prose = lambda n: [random.choice(words) for _ in range(n)]  # noqa: B023, E731
        items = [(str(k) if k % 9 else None, prose(random.choice([0, 1, 2, 9, 10, 11, 40]))) for k in range(30)]
        index = decontam.Index([(k, " ".join(w)) for k, w in items])
        for _ in range(60):
            text = prose(random.randrange(60))
            for _ in range(random.randrange(3)):
                own = random.choice(items)[1]
                a = random.randrange(len(own) + 1)
                text[random.randrange(len(text) + 1) : 0] = own[a : a + random.randrange(30)]
            hit, found = set(), set()
            for k, w in items:
                n = min(10, len(w))
                windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
                for i in range(len(text) - n + 1):
                    if tuple(text[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        found.add(k)
            spans, of = index.hits([x.encode() for x in text])
            assert {p for a, b in spans for p in range(a, b)} == hit and of == found


def test_query_counts_items_without_ids_as_its_sql_does(spark, tmp_path, monkeypatch):
    import duckdb

    monkeypatch.setattr(decontam, "PIECE", 4)
    item = "a b c d e f g h i j k l m n o p q r s t u v w"
    spark.createDataFrame([(None, "x y"), (1, item), (2, "x Y"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "x y z"), (2, None), (3, f"q {item} q"), (4, "c d e f g h i j k l m"), (4, "clean text"), (None, "x, y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = decontam.op6_winnowing(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({decontam.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_decontamination_reads_long_texts_whole(spark):
    item = " ".join(f"q{k}" for k in range(30))
    df = spark.createDataFrame([(1, "w x " * 200_000 + item + " y")], "doc_id long, text string")
    (row,) = decontam.detect(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert row.hit_spans == [400_000, 400_030]


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers(vocabulary):
    import random
    from array import array

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    e = packing.Encoder(vocabulary, most=50)
    random.seed(3)
    parts = ["a", "word", "Été", "b", " ", " ", " ", "\n", "\t", "\x1c", "\xa0", "'s", "'", "1", "!", "...", "<|endoftext|>", "　", "​", "\r\n", "中", "😀", "\x85", " ", "%%%"]
    for _ in range(4000):
        x = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert e.ids(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes(), x


def test_best_fit_and_cuts():
    assert packing.pieces_of(5, 5) == [(0, 5)] and packing.pieces_of(12, 5) == [(0, 2), (2, 5), (7, 5)] and packing.pieces_of(10, 5) == [(0, 5), (5, 5)]
    bins = packing.best_fit([(n, [n]) for n in (6, 5, 5, 4, 3, 7)], 10)
    assert sorted(sorted(m) for _, m in bins) == [[3, 7], [4, 6], [5, 5]]


def test_packing_keeps_every_id(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "CARRY", 3)
    texts = [None, "", "same", "same"] + ["word " * (k * 37 % 3000) for k in range(60)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(20)
    rows = packing.pack(df, vocabulary).collect()
    e = packing.Encoder(vocabulary)
    for k, t in enumerate(texts):
        ids = e.ids(t or "") + bytes(4)
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.pieces_of(len(ids) // 4, 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 2048
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.1 * total / 2048 + 1
    assert packing.pack(df.limit(0), vocabulary).count() == 0


def test_open_bins_are_filled_by_later_pieces(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER", 50)
    e = packing.Encoder(vocabulary)
    one = len(e.ids("word " * 1001)) // 4 - len(e.ids("word " * 1000)) // 4
    texts = ["word " * (n // one) for n in [1100] * 300 + [900] * 300]
    monkeypatch.setattr(packing, "CARRY", 1)

    class Here:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    import pyarrow as pa

    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: Here))
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t])], names=["doc_id", "text"]) for k, t in enumerate(texts)]
    bins = [b for r in packing._first_round(vocabulary, 2048, 0)(batches) for b in r.column(3).to_pylist()]
    assert len(bins) == 300 and sorted(m["doc_id"] for b in bins for m in b) == list(range(600))
    assert all(sum(m["length"] for m in b) <= 2048 for b in bins)


def test_toxicity_learns_and_holds_out(spark):
    import random

    random.seed(1)
    words = [f"w{k}" for k in range(3000)]
    docs, labels = [(10**6, None), (10**6 + 1, "")], [(10**6, 0), (3, None), (None, 1)]
    for k in range(700):
        text = [random.choice(words) for _ in range(random.randint(3, 80))]
        if k % 5 == 0 or k % 7 == 0:
            text.insert(random.randrange(len(text)), random.choice(["Vile!", "rotten,"]))
        docs.append((k, " ".join(text)))
        labels += [(k, int(k % 5 == 0 or k % 7 == 0)), (k, 0)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(4)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    wrong = [k for k in range(700) if got[k].predicted != int(k % 5 == 0 or k % 7 == 0)]
    assert len(got) == len(docs) and len(wrong) <= 7
    assert got[10**6].score == got[10**6 + 1].score < 0.5 and len(model.keys) < 500
    empty = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(df, empty).collect()} == {0}


def test_weights_equal_a_scalar_ftrl():
    import math
    import random

    import numpy as np

    random.seed(2)
    rows = [(np.array(sorted(random.sample(range(40), random.randint(0, 12))), np.uint64), random.randint(0, 1)) for _ in range(120)]
    rows = [(x, int(3 in x or y and 7 in x)) for x, y in rows]
    alpha, beta, l1, l2, epochs, least = 0.5, 1.0, 0.4, 0.1, 3, 5
    z, n = dict.fromkeys(range(40), 0.0), dict.fromkeys(range(40), 0.0)
    known = {i for i in range(40) if sum(i in x for x, _ in rows) >= least}
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    share = sum(y for _, y in rows) / len(rows)
    bias, bias_n = math.log(share / (1 - share)), 0.0
    for _ in range(epochs):
        for x, y in rows:
            own = [int(i) for i in x if int(i) in known]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in own:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.1 / (1 + math.sqrt(bias_n)) * g
    model = toxicity.fit(rows, alpha, beta, l1, l2, epochs, least)
    expected = {i: weight(i) for i in sorted(known) if weight(i)}
    assert len(expected) > 5 and dict(zip(model.keys.tolist(), model.weights.tolist())) == pytest.approx(expected) and model.bias == pytest.approx(bias)


def test_toxicity_passes_over_rows_beyond_its_bound_and_is_never_empty(spark):
    docs = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(2000 if k == 1 else 6)) + (" vile" if k % 3 == 0 else "")) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int")
    whole = toxicity.train(df, labels)
    assert len(whole.keys) and len(toxicity.train(df, labels, sample_features=1500).keys)
    none = toxicity.train(df, labels, sample_features=1)
    assert not len(none.keys) and 0.2 < none.score(toxicity.features("anything")) < 0.5
    scored = toxicity.score(spark.createDataFrame([(None, "vile " * 300_000), (1, None)], "doc_id long, text string"), whole).collect()
    assert len(scored) == 2 and toxicity.score(df.limit(0), whole).count() == 0


def test_held_out_is_never_null(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (1, None), (5, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id: r.held_out for r in toxicity.op10_ftrl(spark, str(tmp_path)).collect()} == {None: False, 1: zlib.crc32(b"1") % 5 == 0, 5: zlib.crc32(b"5") % 5 == 0}


def test_toxicity_sample_has_six_thousand_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(len(rows)))
    docs = spark.range(9000).selectExpr("id AS doc_id", "'w' AS text")
    toxicity.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    assert seen == [6000]


def test_features_that_come_to_the_driver_by_brute_force(spark, monkeypatch):
    import random
    from collections import Counter

    import numpy as np

    random.seed(4)
    docs = [(k, " ".join(f"w{random.randint(0, 400)}" for _ in range(random.choice([0, 3, 60])))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen, plans = [], []
    keep = toxicity.Scratch.keep
    monkeypatch.setattr(toxicity, "fit", seen.extend)
    monkeypatch.setattr(toxicity, "PACKED_AT_ONCE", 500)
    monkeypatch.setattr(toxicity.Scratch, "keep", lambda self, made, name: plans.append(made._jdf.queryExecution().toString()) or keep(self, made, name))
    toxicity.train(df, df.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic"))
    found = [toxicity.features(t) for k, t in docs if zlib.crc32(str(k).encode()) % 5]
    n = Counter(int(f) for x in found for f in x)
    expected = sorted([int(f) for f in x if n[int(f)] >= toxicity.MIN_ROWS] for x in found)
    assert sorted(x.tolist() for x, _ in seen) == expected and all(x.dtype == np.uint64 for x, _ in seen)
    # a feature is never a row of its own
    assert len(plans) == 2 and not any("Generate" in p for p in plans)


def test_a_worker_forgets_what_other_operators_remember(vocabulary):
    import pyarrow as pa

    from candlewick.llm import _shared

    texts = [pa.RecordBatch.from_pydict({"text": ["one two", "three"]})]
    of_words = _shared.lean(lambda batches: (_shared.hashes(_shared.alnum_words(x.as_py())) for b in batches for x in b.column(0)))
    of_ids = _shared.lean(lambda batches: (packing._encoder(vocabulary).ids(x.as_py()) for b in batches for x in b.column(0)), "ids")
    of_none = _shared.lean(lambda batches: (b.num_rows for b in batches), None)
    assert len(list(of_words(texts))) == 2 and {b"one", b"two", b"three"} <= set(_shared._known)
    assert len(list(of_ids(texts))) == 2 and not _shared._known and set(packing._encoders) == {vocabulary}
    kept = packing._encoders[vocabulary]
    assert len(list(of_ids(texts))) == 2 and packing._encoders[vocabulary] is kept
    assert len(list(of_words(texts))) == 2 and not packing._encoders and _shared._known
    assert list(of_none(texts)) == [2] and not _shared._known
