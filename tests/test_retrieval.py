import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick import errors
from candlewick.functions.text import required, sentences, split_sentences
from candlewick.functions.vectors import KeywordEmbedder, LookupEmbedder, ModelEmbedder, checked, clamped, percentile, unit
from candlewick.operators.chunk import Chunker, number
from candlewick.operators.retrieve import Retriever, VectorIndex, nearest, nearest_many
from candlewick.operators.segment import segment

TOPICS = (("force", "mass", "motion", "newton"), ("heat", "entropy", "temperature"), ("cell", "organism"), ("gene", "protein"))
EMBEDDER = KeywordEmbedder(TOPICS)
BLOCK = "file_pos int, block_pos int, source_file string, page_number int, heading string, text string"


def plain(text):
    v = [float(sum(w in text.lower() for w in words)) for words in TOPICS] + [len(text) * 0.001]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def plain_chunks(parts, low, high, pct):
    """The rule in plain Python."""
    v = [plain(p) for p in parts]
    sims = [round(sum(a * b for a, b in zip(x, y)), 9) for x, y in zip(v, v[1:])]
    s = sorted(sims)
    at = (100 - pct) / 100 * (len(s) - 1)
    limit = round(s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at)), 11)
    out, chars = [[parts[0]]], len(parts[0])
    for p, sim in zip(parts[1:], sims):
        if (sim < limit and chars >= low) or chars + len(p) > high:
            out.append([])
            chars = 0
        out[-1].append(p)
        chars += len(p)
    return [" ".join(x) for x in out]


def blocks(spark, texts):
    return spark.createDataFrame([(0, k, "b.pdf", 4, "Head", t) for k, t in enumerate(texts)], BLOCK)


def chunked(spark, texts, *limits):
    rows = Chunker(EMBEDDER, *limits).chunk(blocks(spark, texts)).orderBy("block_pos", "chunk_pos").collect()
    assert all((r.source_file, r.page_number, r.heading) == ("b.pdf", 4, "Head") for r in rows)
    return [(r.block_pos, r.text) for r in rows]


def test_chunker_limits():
    with pytest.raises(ValueError):
        Chunker(EMBEDDER, 100, 100)


def test_single_sentence_is_kept_as_it_is(spark):
    assert chunked(spark, ["  One sentence only \n"], 200, 1200) == [(0, "  One sentence only \n")]


def test_topic_boundary(spark):
    text = "Force is mass times motion. Newton found force. Entropy grows with heat. Temperature is heat."
    assert len(chunked(spark, [text], 10, 1000, 50.0)) >= 2


def test_long_block_respects_max(spark):
    sentence = "The force acts on the mass again and again."
    assert all(len(t) <= 200 + len(sentence) for _, t in chunked(spark, [" ".join([sentence] * 20)], 10, 200)) and len(chunked(spark, [" ".join([sentence] * 20)], 10, 200)) > 1


@pytest.mark.parametrize("pct", [0.0, 25.0, 60.0, 100.0])
def test_chunks_equal_the_rule(spark, pct):
    random.seed(4)
    words = [w for t in TOPICS for w in t] + ["and", "of", "so", "while"]
    texts = [" ".join(" ".join(random.choice(words) for _ in range(random.randint(1, 12))).capitalize() + "." for _ in range(random.randint(2, 30))) for _ in range(60)]
    expected = [(k, c) for k, t in enumerate(texts) for c in plain_chunks([x + "." for x in t.rstrip(".").split(". ")], 60, 150, pct)]
    assert chunked(spark, texts, 60, 150, pct) == expected


def test_two_sentences_never_part_by_topic(spark):
    assert len(chunked(spark, ["Force and mass. Entropy and heat."], 1, 1000, 0.0)) == 1


def test_no_blocks_and_blank_blocks(spark):
    assert chunked(spark, [], 10, 100) == [] and chunked(spark, [" ", ""], 10, 100) == []


def test_numbers_are_consecutive_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(13)
    assert [(r.x, r.n) for r in number(rows, ["x"], "n", 5).orderBy("x").collect()] == [(k, k + 5) for k in range(1000)]


def test_segments_by_heading(spark):
    rows = [
        ("f", 1, 0, "before", False), ("f", 1, 1, "CHAPTER 1", True), ("f", 1, 2, "a", False), ("f", 1, 3, " ", False), ("f", 1, 4, "b ", False), ("f", 2, 0, "carried", False),
        ("f", 2, 1, "CHAPTER 2", True), ("f", 2, 2, "CHAPTER 3", True), ("f", 2, 3, "c", False), ("f", 2, 4, "CHAPTER 4", True), ("g", None, 0, "d", False),
    ]
    df = spark.createDataFrame(rows, "file string, page int, line_no int, line string, is_heading boolean")
    got = [(r.file, r.page, r.heading, r.text, r.block_pos) for r in segment(df).orderBy("file", "block_pos").collect()]
    assert got == [("f", 1, "", "before", 0), ("f", 1, "CHAPTER 1", "a\n \nb", 1), ("f", 2, "CHAPTER 1", "carried", 2), ("f", 2, "CHAPTER 3", "c", 3), ("g", None, "", "d", 0)]


def test_vectors(spark):
    row = spark.range(1).select(
        EMBEDDER.vector(F.lit("Newton: force on MASS")).alias("v"), unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        percentile(F.array(*map(F.lit, [1.0, 2.0, 4.0])), 0.75).alias("p"), clamped(F.lit(1.5)).alias("c"), clamped(F.lit(float("nan"))).alias("n"),
    ).first()
    assert row.v == pytest.approx(plain("Newton: force on MASS")) and math.isclose(sum(x * x for x in row.v), 1)
    assert row.z == [0, 0] and row.p == 3.0 and row.c == 1.0 and math.isnan(row.n)


def test_model_embedder_gives_unit_vectors(spark):
    class Counting:
        def encode(self, texts):
            return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    e = ModelEmbedder(lambda: Counting(), "counting")
    assert [r.v for r in spark.createDataFrame([("ab",), ("c",)], "t string").select(e.vector(F.col("t")).alias("v")).collect()] == [pytest.approx([0.6, 0.8])] * 2
    text = "One here. Two here. Three here."
    assert [r.text for r in Chunker(e, 5, 1000).chunk(blocks(spark, [text])).collect()] == [text]
    assert ModelEmbedder(lambda: type("One", (), {"encode": lambda self, x: [3.0, 4.0]})(), "flat").encode(["a"]).tolist() == [pytest.approx([0.6, 0.8])]


def test_encoding_nothing_and_models_that_fail_raise(spark):
    def absent():
        raise ImportError("no such model")

    for e in (EMBEDDER, ModelEmbedder(absent, "absent")):
        with pytest.raises(errors.EmbeddingError, match="no texts"):
            e.encode([])
    with pytest.raises(errors.EmbeddingError, match="no such model"):
        ModelEmbedder(absent, "absent").encode(["a"])
    with pytest.raises(errors.EmbeddingError):
        LookupEmbedder({"a": [1.0]}).encode(["b"])
    for made in (lambda e: blocks(spark, ["One here. Two here."]).select(e.vector(F.col("text"))), lambda e: Chunker(e).chunk(blocks(spark, ["One here. Two here."]))):
        with pytest.raises(Exception, match="EmbeddingError.*no such model"):
            made(ModelEmbedder(absent, "absent")).collect()


def test_local_and_column_forms_agree(spark):
    random.seed(4)
    parts = ["Force", " mass", ". ", "!\n", "\n\n", "\u0964 ", " \x1c", "é", "\xa0", "HEAT", "? ", "\u3000", "cell."]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", sentences(F.col("t")).alias("s"), EMBEDDER.vector(F.col("t")).alias("v")).collect():
        assert r.s == split_sentences(texts[r.k]) and r.v == pytest.approx(EMBEDDER.encode([texts[r.k]])[0].tolist())


def test_long_blocks_are_embedded_in_parts(spark, monkeypatch):
    import candlewick.operators.chunk as c

    random.seed(6)
    texts = [" ".join(random.choice(["Force and mass.", "The heat is on.", "A cell!", "Of genes and proteins?"]) for _ in range(n)) for n in (90, 1, 2, 37, 500)]
    whole = Chunker(EMBEDDER, 20, 200).texts(texts)
    monkeypatch.setattr(c, "SENTENCES", 16)
    assert Chunker(EMBEDDER, 20, 200).texts(texts) == whole and [len(x) for x in whole][1] == 1


def arrow_pass(spark, monkeypatch, chunker):
    """What chunk() gives to mapInArrow()."""
    df, got = blocks(spark, ["a"]).select("block_pos", "text"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: got.append(run))
    chunker.chunk(df)
    return got[0]


def most_allocated(run, batches):
    """The rows of run over batches, and the most bytes that Arrow held for them."""
    own = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(own)
    pa.set_memory_pool(pool)
    try:
        rows = [row for b in run(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns))]
    finally:
        pa.set_memory_pool(own)
    return rows, pool.max_memory()


def test_a_long_text_is_not_repeated_for_its_chunks(spark, monkeypatch):
    text = " ".join(f"Force {k:06d} moves a mass for longer yet." for k in range(1_000))
    batch = pa.record_batch([pa.array([7, 8], pa.int32()), pa.array([text, "The cell."])], names=["block_pos", "text"])
    rows, most = most_allocated(arrow_pass(spark, monkeypatch, Chunker(EMBEDDER, 10, 20)), [batch])
    assert rows == [*((7, x, k) for k, x in enumerate(split_sentences(text))), (8, "The cell.", 0)]
    assert most < 10 * len(text)  # with a copy of the text for each of its chunks 1,000 times that


def test_chunking_holds_no_more_for_more_blocks(spark, monkeypatch):
    text = " ".join(f"Force {k:03d} moves a mass. Heat isn't a cell." for k in range(400))
    run, most = arrow_pass(spark, monkeypatch, Chunker(EMBEDDER)), {}
    for n in (200, 800):
        batch = pa.record_batch([pa.array(range(n), pa.int32()), pa.array([text] * n)], names=["block_pos", "text"])
        rows, most[n] = most_allocated(run, [batch])
        expected = Chunker(EMBEDDER).texts([text])[0]
        assert rows == [(k, x, i) for k in range(n) for i, x in enumerate(expected)]
    assert most[800] < 1.5 * most[200] and most[800] < 5_000_000  # 800 texts have 14 MB


CHUNKS = "text string, source_file string, heading string, page_number int, chunk_id long"
SAMPLE = [("Newton: force, mass, motion.", "p.pdf", "Laws", 3, 0), ("Entropy, heat, temperature.", "p.pdf", "", None, 1), ("The cell of an organism. It lives.", "b.docx", "", None, 2)]


@pytest.fixture
def index(spark):
    made = VectorIndex(spark, EMBEDDER)
    made.build(spark.createDataFrame(SAMPLE, CHUNKS))
    return made


def test_unbuilt_and_empty(spark, tmp_path):
    made = VectorIndex(spark, EMBEDDER)
    assert not made.is_built
    assert made.stats().first().asDict() == {"total_chunks": 0, "total_source_files": 0, "source_files": []}
    for f in (lambda: made.search("force"), lambda: made.search(" "), lambda: made.save(str(tmp_path))):
        with pytest.raises(errors.IndexNotBuiltError):
            f()
    with pytest.raises(errors.EmptyIndexError):
        made.build(spark.createDataFrame([], CHUNKS))
    with pytest.raises(FileNotFoundError):
        made.load(str(tmp_path / "none"))


def test_search(index):
    assert index.search("Which force moves a mass?", 1).first().chunk_id == 0
    assert index.search("heat", 99).count() == 3 and index.search("heat", 0).count() == 1 and index.search("heat", -2).count() == 1
    assert index.search("  ").count() == 0
    assert all(-1 <= r.score <= 1 for r in index.search("cell", 3).collect())
    assert index.stats().first().source_files == ["b.docx", "p.pdf"]


def test_add_goes_on(spark, index):
    index.add(spark.createDataFrame([], CHUNKS))
    index.add(spark.createDataFrame([("The gene makes a protein.", "g.pdf", "", None, 0)], CHUNKS))
    assert sorted((r.pos, r.chunk_id) for r in index.rows.collect()) == [(0, 0), (1, 1), (2, 2), (3, 0)]
    assert index.search("gene protein", 1).first().source_file == "g.pdf"
    fresh = VectorIndex(spark, EMBEDDER)
    fresh.add(spark.createDataFrame(SAMPLE, CHUNKS))
    assert fresh.is_built and fresh.count == 3


def test_save_and_load(spark, index, tmp_path, caplog):
    index.save(str(tmp_path / "i"))
    again = VectorIndex(spark, KeywordEmbedder(TOPICS, name="other"))
    with caplog.at_level("WARNING"):
        again.load(str(tmp_path / "i"))
    assert "other" in caplog.text
    assert [(r.pos, r.score) for r in again.search("heat", 3).collect()] == [(r.pos, r.score) for r in index.search("heat", 3).collect()]
    (tmp_path / "i" / "meta.json").unlink()
    again.load(str(tmp_path / "i"))
    assert again.count == 3


def test_an_index_grows_in_its_folder(spark, index, tmp_path):
    folder = str(tmp_path / "i")
    index.save(folder)
    reader = VectorIndex(spark, EMBEDDER)
    reader.load(folder)
    for k in range(3):
        grown = VectorIndex(spark, EMBEDDER)
        grown.load(folder)
        grown.add(spark.createDataFrame([(f"The gene {k} makes a protein.", f"g{k}.pdf", "", None, 0)], CHUNKS))
        grown.save(folder)
        grown.save(folder) if k == 1 else None
        assert grown.rows.count() == grown.count == 4 + k and grown.search("gene protein", 1).first().source_file == "g0.pdf"
        if not k:
            assert reader.rows.count() == 3
    again = VectorIndex(spark, EMBEDDER)
    again.load(folder)
    assert sorted((r.pos, r.source_file) for r in again.rows.collect())[3:] == [(3, "g0.pdf"), (4, "g1.pdf"), (5, "g2.pdf")]
    assert len(list((tmp_path / "i").glob("chunks-*"))) == 2
    # a version that wasn't completed, and a broken meta.json, leave the last complete one
    (tmp_path / "i" / "chunks-000099").mkdir()
    (tmp_path / "i" / "meta.json").write_text("{")
    again.load(folder)
    assert again.count == 6


def test_ties_and_nan(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [float("nan"), 0.0])], "pos long, vector array<double>")
    known = rows.where("pos < 4").unionByName(spark.createDataFrame([(0, None)], rows.schema))
    assert [r.pos for r in nearest(known, [1.0, 0.0], 2).collect()] == [1, 3] and nearest(known, [1.0, 0.0], 9).count() == 3
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.pos) for r in nearest_many(known, asked, 2).orderBy("rank").collect()] == [(7, 1), (7, 3)]
    for found in (nearest(rows, [1.0, 0.0], 2), nearest_many(rows, asked, 2), rows.select(checked(F.lit(1.2), 0.0001))):
        with pytest.raises(Exception, match="score"):
            found.collect()
    with pytest.raises(Exception, match="text is blank"):
        VectorIndex(spark, EMBEDDER).build(spark.createDataFrame([(" ", "f", "", None, 0)], CHUNKS))
    with pytest.raises(Exception, match="text is blank"):
        spark.range(1).select(required(F.lit(None).cast("string"))).collect()
    assert spark.range(1).select(required(F.lit("a"))).first()[0] == "a"


def test_ten_thousand_questions_take_one_scan(spark):
    rows = spark.range(50).selectExpr("id AS pos", "array(CAST(id AS DOUBLE) / 50, 0D) AS vector")
    asked = spark.range(10_000).selectExpr("id AS query_id", "array(1D, 0D) AS vector")
    found = nearest_many(rows, asked, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.count() == 30_000 and {r.pos for r in found.where("rank = 1").collect()} == {49}


def test_many_questions_equal_one_by_one(spark):
    random.seed(2)
    rows = spark.createDataFrame([(k, [random.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for k in range(200)], "pos long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, [random.random() for _ in range(3)]) for k in range(7)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.pos for r in nearest_many(rows, asked, 4).collect()}
    for q in asked.collect():
        assert [got[q.query_id, k] for k in range(1, 5)] == [r.pos for r in nearest(rows, q.vector, 4).collect()]


def test_retriever(spark, index):
    r = Retriever(index, default_top_k=2, highlight_sentences=0)
    assert r.embedder is EMBEDDER and r.highlight_sentences == 1
    assert r.retrieve("force").count() == 2 and r.retrieve("force", 1).count() == 1 and r.retrieve(" ").count() == 0
    found = r.retrieve("cell organism", 1).first()
    assert found.highlight == "The cell of an organism."
    assert r.retrieve("force", 1).first().highlight == SAMPLE[0][0]
    many = r.retrieve_many(spark.createDataFrame([(7, "cell organism"), (8, " ")], "query_id long, question string"), 1).collect()
    assert [(x.query_id, x.highlight) for x in many] == [(7, "The cell of an organism.")]


def test_highlight_order_and_ties(spark):
    text = "A one. B two. C three. D four."
    known = {"q": [1, 0, 0], "A one.": [0.2, 1, 0], "B two.": [1, 0.1, 0], "C three.": [0, 1, 0], "D four.": [1, 0.2, 0], text: [1, 1, 1]}
    made = VectorIndex(spark, LookupEmbedder(known))
    made.build(spark.createDataFrame([(text, "f.pdf")], "text string, source_file string"))
    assert Retriever(made, highlight_sentences=2).retrieve("q").first().highlight == "B two. D four."
    tied = LookupEmbedder(known | {"D four.": [1, 0.1, 0]})
    assert Retriever(made, tied, highlight_sentences=1).retrieve("q").first().highlight == "D four."
