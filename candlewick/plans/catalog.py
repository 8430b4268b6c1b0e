"""The named queries of the retrieval engine and the SQL that each must equal.

Blocks stand for the documents' texts, their sources for files; topics are fragments of the four languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import text as ft
from candlewick.functions.vectors import KeywordEmbedder
from candlewick.operators.chunk import Chunker, number, similarities, threshold
from candlewick.operators.retrieve import Retriever, VectorIndex, nearest, nearest_many, wanted
from candlewick.operators.segment import segment
from candlewick.storage import Scratch
from candlewick.tables import table

TOPICS = (("the", "and", "tion"), ("le", "de", "eau"), ("er", "sch", "en"), ("el", "que", "ci"))
EMBEDDER = KeywordEmbedder(TOPICS)
CHUNKER = Chunker(EMBEDDER)
QUESTION = "The and tion of schen"
LINES_PER_PAGE = 5
READABLE = (".docx", ".html", ".pdf")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL that the oracles share

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(32) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?।])[\s\x1c-\x1f]+|\n{{{{2,}}}}', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '')"


def _sentences(x: str) -> str:
    return _SENTENCES.format(x)


def _raw(x: str) -> str:
    counts = [" + ".join(f"CAST(contains(lower({x}), '{w}') AS DOUBLE)" for w in topic) for topic in TOPICS]
    return f"[{', '.join(counts)}, length({x}) * 0.001]"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda y: CASE WHEN sqrt(list_sum(list_transform({v}, lambda z: z * z))) > 0 THEN y / sqrt(list_sum(list_transform({v}, lambda z: z * z))) ELSE y END)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda j: CAST({a}[j] AS DOUBLE) * CAST({b}[j] AS DOUBLE)))"


_VECTORS = f"""
d AS (SELECT doc_id, source, text, {_sentences("text")} AS ss FROM documents WHERE trim(coalesce(text, ''), {_WS}) <> ''),
e AS (SELECT doc_id, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM d),
r AS (SELECT doc_id, i, s, {_raw("s")} AS w FROM e),
v AS (SELECT doc_id, i, s, {_unit("w")} AS v FROM r),
m AS (SELECT b.doc_id, b.i, round({_dot("a.v", "b.v")}, 9) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
t AS (SELECT doc_id, round(quantile_cont(sim, {(100 - CHUNKER.breakpoint_percentile) / 100}), 11) AS thr FROM m GROUP BY doc_id)"""
_CHUNKS = f"""{_VECTORS},
x AS (SELECT v.doc_id, v.i, v.s, sim, thr FROM v LEFT JOIN m USING (doc_id, i) LEFT JOIN t USING (doc_id)),
f AS (SELECT doc_id, i, s, length(s) AS chars, 0 AS c FROM x WHERE i = 0
      UNION ALL
      SELECT x.doc_id, x.i, x.s, CASE WHEN k THEN length(x.s) ELSE chars + length(x.s) END, c + CAST(k AS INT)
      FROM (SELECT x.*, f.chars, f.c, (x.sim < x.thr AND f.chars >= {CHUNKER.min_chars}) OR f.chars + length(x.s) > {CHUNKER.max_chars} AS k FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1) x),
c AS (SELECT doc_id, c AS chunk_pos, string_agg(s, ' ' ORDER BY i) AS text FROM f GROUP BY doc_id, c),
h AS (SELECT doc_id, source, chunk_pos, CASE WHEN len(ss) = 1 THEN d.text ELSE c.text END AS text FROM c JOIN d USING (doc_id)),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS pos FROM h)"""
_INDEX = f"""{_CHUNKS},
ir AS (SELECT pos, source, text, {_raw("text")} AS w FROM n),
ix AS (SELECT pos, source, text, {_unit("w")} AS v FROM ir)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("source_file"), "text")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(CHUNKER.chunk(_blocks(spark, sf_dir)), ["doc_id", "chunk_pos"])


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    index = VectorIndex(spark, EMBEDDER)
    index.build(_chunks(spark, sf_dir), numbered=True)
    return index


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks the documents, answers one question: label, score and highlight of the five nearest chunks."""
    found = Retriever(_index(spark, sf_dir)).retrieve(QUESTION, 5)
    label = ft.location_label(F.col("source_file"), F.col("heading"), F.col("page_number"))
    return found.select("pos", label.alias("label"), F.round("score", 6).alias("score"), "highlight")


@query(f"SELECT doc_id, source || ' › ' || lang || CASE WHEN doc_id % 7 <> 0 THEN ' (page ' || CAST(doc_id % 7 AS VARCHAR) || ')' ELSE '' END AS label FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source || CASE WHEN doc_id % 7 <> 0 THEN ' (page ' || CAST(doc_id % 7 AS VARCHAR) || ')' ELSE '' END FROM documents WHERE doc_id % 2 = 1")
def location_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    heading = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return docs.select("doc_id", ft.location_label(F.col("source"), heading, F.col("doc_id") % 7).alias("label"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE text END AS best FROM conversations")
def best_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ft.best_text(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), F.col("text")).alias("best"))


@query("SELECT regexp_extract(lower(regexp_extract(url, '[^/]*$')), '[^.](\\.[^./]*)$', 1) AS ext, count(*) AS files, count(*) FILTER (regexp_extract(lower(regexp_extract(url, '[^/]*$')), '[^.](\\.[^./]*)$', 1) IN ('.docx', '.html', '.pdf')) AS readable FROM pages GROUP BY 1")
def file_route(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(ft.extension(F.col("url")).alias("ext"))
    return pages.groupBy("ext").agg(F.count("*").alias("files"), F.count(F.when(F.col("ext").isin(*READABLE), 1)).alias("readable"))


@query(f"SELECT doc_id, CAST(i AS INT) AS i, s FROM (SELECT doc_id, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents))")
def sentence_split(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", F.posexplode(ft.sentences(F.col("text"))).alias("i", "s"))


_HEADING = rf"""(len(s) > 0 AND length(s) <= 90 AND (regexp_matches(s, '(?i)^(chapter|unit|section|அத்தியாயம்|பாடம்)\s+\d') OR regexp_matches(s, '^\d+(\.\d+)*\s+[A-Z][a-zA-Z ]{{3,60}}$')
    OR (regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '[\p{{Ll}}\p{{Lt}}]') AND len(string_split_regex(s, '\s+')) BETWEEN 3 AND 12)))"""
_LINES = f"SELECT doc_id, i, x, trim(x, {_WS}) AS s FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, CAST(i AS INT) AS line_no, {_HEADING} AS is_heading FROM ({_LINES})")
def heading_detect(spark, sf_dir):
    lines = _blocks(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", ft.looks_like_heading(F.col("line")).alias("is_heading"))


@query(f"SELECT doc_id, n_chars FROM documents WHERE trim(coalesce(text, ''), {_WS}) <> ''")
def nonblank_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~ft.is_blank(F.col("text"))).select("doc_id", "n_chars")


@query(
    f"""
WITH l AS ({_LINES}), h AS (SELECT *, {_HEADING} AS h, i // {LINES_PER_PAGE} AS page FROM l),
g AS (SELECT *, sum(CAST(h AS INT)) OVER w AS sec, coalesce(last_value(CASE WHEN h THEN s END IGNORE NULLS) OVER w, '') AS heading FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, page, sec, heading, trim(string_agg(x, chr(10) ORDER BY i), {_WS}) AS text FROM g WHERE NOT h GROUP BY ALL)
SELECT doc_id, CAST(page AS INT) AS page, heading, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, sec) - 1 AS INT) AS block_pos FROM b WHERE text <> ''
"""
)
def heading_segments(spark, sf_dir):
    lines = _blocks(spark, sf_dir).select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = lines.withColumns({"page": F.expr(f"CAST(line_no DIV {LINES_PER_PAGE} AS INT)"), "is_heading": ft.looks_like_heading(F.col("line"))})
    return segment(marked).select(F.col("file").alias("doc_id"), "page", "heading", "text", F.col("block_pos").cast("int").alias("block_pos"))


@query(f"WITH r AS (SELECT doc_id, {_raw('text')} AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, {_unit('w')} AS v FROM r) SELECT doc_id, {', '.join(f'round(v[{k + 1}], 9) AS v{k}' for k in range(len(TOPICS) + 1))} FROM v")
def keyword_embed(spark, sf_dir):
    rows = _blocks(spark, sf_dir).where("text IS NOT NULL").select("doc_id", EMBEDDER.vector(F.col("text")).alias("v"))
    return rows.select("doc_id", *[F.round(F.get("v", k), 9).alias(f"v{k}") for k in range(len(TOPICS) + 1)])


def _similar(spark, sf_dir):
    rows = _blocks(spark, sf_dir).where(~ft.is_blank(F.col("text")))
    return rows.select("doc_id", ft.let(ft.sentences(F.col("text")), lambda p: ft.let(EMBEDDER.vectors(p), similarities)).alias("sims"))


@query(f"WITH {_VECTORS} SELECT doc_id, CAST(i - 1 AS INT) AS i, sim FROM m")
def adjacent_similarity(spark, sf_dir):
    rows = _similar(spark, sf_dir).select("doc_id", F.posexplode("sims").alias("i", "sim"))
    return rows.select("doc_id", "i", "sim")


@query(f"WITH {_VECTORS} SELECT doc_id, thr AS threshold FROM t")
def breakpoint_threshold(spark, sf_dir):
    rows = _similar(spark, sf_dir).where("size(sims) > 0")
    return rows.select("doc_id", threshold(F.col("sims"), CHUNKER.breakpoint_percentile).alias("threshold"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(chunk_pos AS INT) AS chunk_pos, text FROM h")
def semantic_chunks(spark, sf_dir):
    return CHUNKER.chunk(_blocks(spark, sf_dir)).select("doc_id", "chunk_pos", "text")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT pos AS chunk_id, doc_id, CAST(chunk_pos AS INT) AS chunk_pos FROM n")
def chunk_ids(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_pos")


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query(f"SELECT vec_id, round({_dot('embedding', 'q')}, 5) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY {_dot('embedding', 'q')} DESC, vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    rows = nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 5, "embedding", "vec_id")
    return rows.select("vec_id", F.round("score", 5).alias("score"))


@query(
    f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, {_dot("embedding", "q")} AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(greatest(-1, least(1, score)), 5) AS score FROM r WHERE rank <= 10
"""
)
def vector_topk_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return nearest_many(rows, asked, 10, tie="vec_id").select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


@query(f"WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY round({_dot('embedding', 'q')}, 12) DESC, vec_id) AS r FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) SELECT k, count(*) AS n, min(vec_id) AS least FROM s, (VALUES (-3), (0), (1), (1000000)) AS t(k) WHERE r <= greatest(1, k) GROUP BY k")
def topk_clamped_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    vector, n, out = _vector(spark, sf_dir, 0), rows.count(), None
    for k in (-3, 0, 1, 1_000_000):
        one = nearest(rows, vector, wanted(k, n), "embedding", "vec_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("k", "n", "least")


@query(f"WITH d AS (SELECT doc_id, source, text FROM documents WHERE trim(coalesce(text, ''), {_WS}) <> '') SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS pos, doc_id AS chunk_id, source AS source_file FROM d")
def incremental_add(spark, sf_dir):
    rows = _blocks(spark, sf_dir).where(~ft.is_blank(F.col("text"))).withColumnRenamed("doc_id", "chunk_id")
    index = VectorIndex(spark, EMBEDDER)
    index.add(rows.where("chunk_id % 2 = 0"))
    index.add(rows.where("chunk_id % 2 = 1"))
    return index.rows.select("pos", "chunk_id", "source_file")


@query(ORACLES["incremental_add"])
def index_grow(spark, sf_dir):
    """Built, saved, loaded, grown and saved again into the same folder."""
    rows = _blocks(spark, sf_dir).where(~ft.is_blank(F.col("text"))).withColumnRenamed("doc_id", "chunk_id")
    folder = Scratch(spark, "grown").at
    for k in (0, 1):
        index = VectorIndex(spark, EMBEDDER)
        if k:
            index.load(folder)
        index.add(rows.where(F.col("chunk_id") % 2 == k))
        index.save(folder)
    again = VectorIndex(spark, EMBEDDER)
    again.load(folder)
    return again.rows.select("pos", "chunk_id", "source_file")


_ASKED = f"q AS (SELECT {_unit('w')} AS q FROM (SELECT {_raw(chr(39) + QUESTION + chr(39))} AS w))"
_TOP = f"{_ASKED}, p AS (SELECT pos, source, text, {_dot('v', 'q')} AS score FROM ix, q ORDER BY round(score, 12) DESC, pos LIMIT 5)"


@query(f"WITH RECURSIVE {_INDEX}, {_TOP} SELECT pos, source AS label, round(greatest(-1, least(1, score)), 6) AS score FROM p")
def text_query_topk(spark, sf_dir):
    found = _index(spark, sf_dir).search(QUESTION, 5)
    return found.select("pos", ft.location_label(F.col("source_file"), F.col("heading"), F.col("page_number")).alias("label"), F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE {_INDEX}, qw AS (SELECT item_id AS query_id, {_raw("text")} AS w FROM benchmark), q AS (SELECT query_id, {_unit("w")} AS q FROM qw),
s AS (SELECT query_id, q, pos, text, {_dot("v", "q")} AS score FROM ix, q),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos) AS rank FROM s),
w AS (SELECT query_id, q, pos, rank, score, text, {_sentences("text")} AS ps FROM p WHERE rank <= 3),
y AS (SELECT query_id, pos, q, unnest(range(0, len(ps))) AS j, unnest(ps) AS z FROM w WHERE len(ps) > 2),
yr AS (SELECT *, {_raw("z")} AS zw FROM y), yv AS (SELECT *, {_unit("zw")} AS zv FROM yr),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY round({_dot("zv", "q")}, 9) DESC, j DESC) AS o FROM yv),
hl AS (SELECT query_id, pos, string_agg(z, ' ' ORDER BY j) AS hl FROM b WHERE o <= 2 GROUP BY query_id, pos)
SELECT query_id, CAST(rank AS INT) AS rank, pos, round(greatest(-1, least(1, score)), 6) AS score, coalesce(hl, text) AS highlight FROM w LEFT JOIN hl USING (query_id, pos)"""
)
def highlight(spark, sf_dir):
    found = Retriever(_index(spark, sf_dir), highlight_sentences=2).retrieve_many(_questions(spark, sf_dir), 3)
    return found.select("query_id", "rank", "pos", F.round("score", 6).alias("score"), "highlight")


@query(f"WITH RECURSIVE {_INDEX}, {_TOP} SELECT string_agg('#' || r || ' — ' || source || ' · similarity ' || printf('%.3f', greatest(-1, least(1, score))) || chr(10) || text, chr(10) ORDER BY r) AS answer FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, pos) AS r FROM p)")
def answer_render(spark, sf_dir):
    found = _index(spark, sf_dir).search(QUESTION, 5)
    ordered = F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "pos", "source_file", "score", "text")))
    lines = F.transform(ordered, lambda x, i: ft.rendered((i + 1).cast("int"), x.source_file, x.score, x.text))
    answer = F.array_join(lines, "\n")
    return found.agg(F.when(F.count("*") == 0, ft.NO_RESULT).otherwise(answer).alias("answer"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT source) AS total_source_files, array_to_string(list_sort(list(DISTINCT source)), ',') AS source_files FROM n")
def index_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats().withColumn("source_files", F.array_join("source_files", ","))


@query(f"WITH RECURSIVE {_INDEX}, {_TOP} SELECT pos, source AS source_file, text, round(greatest(-1, least(1, score)), 6) AS score FROM p")
def index_roundtrip(spark, sf_dir):
    index = _index(spark, sf_dir)
    index.save(folder := Scratch(spark, "saved").at)
    again = VectorIndex(spark, EMBEDDER)
    again.load(folder)
    return again.search(QUESTION, 5).select("pos", "source_file", "text", F.round("score", 6).alias("score"))
