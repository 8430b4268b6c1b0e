r"""Substring deduplication by hashing lines and what they are made of.

Lines are cut into clauses, after marks [.!?,;:]+ that white space follows, so that a passage that was put into a line
has clauses of its own. A clause's normal form is its words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z lower-cased,
joined by spaces; clauses without words count for nothing. A unit is the shortest run of clauses, over ends of lines
too, that has MIN_WORDS words, from each clause on, and the shortest up to the text's end. Digests (128 bits) of the
units are grouped over all documents; the earliest occurrence, by doc_id, then row, then place, stays. Clauses of later
ones go; neighbouring clauses that go are one span, with its offsets in the original text (code points, ends exclusive).
So every clause that goes stands at an earlier place, and what a repeated passage keeps is at most a cut clause at
either end.

Earliest occurrences of a digest are found before they are shuffled, and a join brings them back to the units, so a
line that a third of all rows hold is split over tasks by adaptive execution; no task collects a digest.

Defined results: null and empty texts have no units; repeated rows are documents of their own, of which the first keeps
its text; a null doc_id ranks last; a document none of whose text goes is returned with no spans. Very long texts are
read whole, as a row of a few numbers for each clause. Extra columns are ignored by spans() and kept by cleaned(). An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm._shared import Scratch, alnum_words, free_name, lean, table

MIN_WORDS = 10
#: Words from which a span counts as a passage.
PASSAGE_WORDS = 25
#: Marks that end a clause, and white space inside lines.
MARKS, SPACES = ".!?,;:", "\x20\x09\x0b\x0c\x0d"

_CUT = re.compile(rf"[{MARKS}]+[{SPACES}]+|\n")


def clauses(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """Start, end and words of the clauses that have words."""
    text, out, at = text or "", [], 0
    for m in [*_CUT.finditer(text), None]:
        end = m.end() if m else len(text)
        if words := alnum_words(part := text[at:end]):
            out.append((at, at + len(part.rstrip(SPACES + "\n")), words))
        at = end
    return out


def units(found: list[tuple[int, int, list[bytes]]], min_words: int) -> list[tuple[int, int]]:
    """First and last clause of the shortest runs with min_words words, from each clause on and up to the end."""
    sizes, out, last, n = [len(w) for _, _, w in found], [], 0, 0
    for i, size in enumerate(sizes):
        while last < len(sizes) and n < min_words:
            n += sizes[last]
            last += 1
        if n < min_words:
            break
        out.append((i, last - 1))
        n -= size
    # of the runs up to the end only those remain that the loop broke off at
    if out and out[-1][1] < len(sizes) - 1:
        n, i = 0, len(sizes)
        while n < min_words:
            i -= 1
            n += sizes[i]
        out.append((i, len(sizes) - 1))
    return out


def _units(min_words: int):
    """row, doc_id and of each unit its place in code points and in words, packed, and its digest in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            places, words, digests, sizes = [], [], [], [0]
            for text in batch.column(2):
                found = clauses(text.as_py())
                before = [0]
                for _, _, w in found:
                    before.append(before[-1] + len(w))
                joined = [b" ".join(w) for _, _, w in found]
                for i, j in units(found, min_words):
                    places.append(found[i][0] << 32 | found[j][1])
                    words.append(before[i] << 32 | before[j + 1])
                    digests.append(xxh3_128_digest(b" ".join(joined[i : j + 1])))
                sizes.append(len(places))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [np.array(places, np.int64), np.array(words, np.int64), halves[:, 0], halves[:, 1]]
            listed = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.ascontiguousarray(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *listed], names=["row", "doc_id", "place", "words", "d1", "d2"])

    return run


SPAN = "array<struct<start:int,end:int,first_doc_id:bigint,n_words:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64()), ("n_words", pa.int32())]))


def _spanned(listed: list[dict]) -> list[dict]:
    """Units in order, joined where no word lies between them."""
    out: list[dict] = []
    for x in listed:
        start, end, a, b = x["place"] >> 32, x["place"] & 0xFFFFFFFF, x["words"] >> 32, x["words"] & 0xFFFFFFFF
        if out and a <= out[-1]["to"]:
            out[-1]["end"], out[-1]["to"] = max(end, out[-1]["end"]), max(b, out[-1]["to"])
        else:
            out.append({"start": start, "end": end, "first_doc_id": x["first_doc_id"], "from": a, "to": b})
    for x in out:
        x["n_words"] = x.pop("to") - x.pop("from")
    return out


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = [sorted(x or (), key=lambda u: (u["place"] >> 32, u["place"])) for x in batch.column(3).to_pylist()]
        going = [[u for u in x if u["goes"]] for x in listed]
        arrays = [pa.array([len(x) for x in going], pa.int64()), pa.array(map(_spanned, going), _SPAN), pa.array([_spanned([u for u in x if u["shared"]]) for x in listed], _SPAN)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["row", "doc_id", "n_units", "n_removed", "removed", "shared"])


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, doc_id, n_units, n_removed (units that go), and removed and shared, arrays of (start, end, first_doc_id, n_words).

    shared are the spans of units that other rows have too, whether they go or stay as the first. first_doc_id is that of
    a span's first unit.
    """
    return _spans(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), min_words, Scratch(docs.sparkSession, "lines"))


def _spans(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    docs = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = ", ".join(f"{c} array<long>" for c in ("place", "words", "d1", "d2"))
    made = scratch.keep(docs.mapInArrow(lean(_units(min_words)), f"row long, doc_id long, {kinds}"), "units")
    each = made.select("row", "doc_id", F.inline(F.arrays_zip("place", "words", "d1", "d2")))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place")
    first = each.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("f"), F.max("row").alias("most"), F.min("row").alias("least")).where("n > 1")
    # each step is written, so that its shuffle goes before the next one's comes
    first = scratch.keep(first.selectExpr("d1", "d2", "f.doc_id AS first_doc_id", "f.row AS first_row", "f.place AS first_place", "least <> most AS shared"), "first")
    again = each.drop("doc_id").join(first, ["d1", "d2"]).withColumn("goes", F.expr("row <> first_row OR place <> first_place")).where("goes OR shared")
    again = scratch.keep(again.select("row", "place", "words", "first_doc_id", "goes", "shared"), "again")
    scratch.drop("first")
    hits = again.groupBy("row").agg(F.collect_list(F.struct("place", "words", "first_doc_id", "goes", "shared")).alias("hits"))
    found = made.select("row", "doc_id", F.size("place").cast("long").alias("n_units")).join(hits, "row", "left").select("row", "doc_id", "n_units", "hits")
    return found.mapInArrow(lean(_spans_of), f"row long, doc_id long, n_units long, n_removed long, removed {SPAN}, shared {SPAN}")


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without these spans, the spaces beside them, and the lines that they leave empty."""
    out, at = [], 0
    for a, b in removed:
        left, right = len(text[:a].rstrip(SPACES)), len(text) - len(text[b:].lstrip(SPACES))
        opens, closes = left == 0 or text[left - 1] == "\n", right == len(text) or text[right] == "\n"
        if opens and closes:
            a, b = (left, right + 1) if right < len(text) else (max(left - 1, at), right)
        else:
            a, b = (left, right) if closes else (a, right)
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated text cut from text, and removed (a column of that name is replaced)."""
    spark, docs = docs.sparkSession, docs.drop("removed")
    names, key = [*docs.columns, "removed"], free_name(docs.columns, "row")
    scratch = Scratch(spark, "lines-docs")
    kept = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    found = _spans(kept.select(F.col(key).alias("row"), "doc_id", "text"), min_words, scratch).select(F.col("row").alias(key), "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            columns = list(batch.columns)
            texts = [x and without(x, [(s["start"], s["end"]) for s in r]) for x, r in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = kept.join(found, key).select(*names)
    return joined.mapInArrow(lean(run), T.StructType(joined.schema.fields))


def op8_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    passages = f"CAST(size(filter({{}}, x -> x.n_words >= {PASSAGE_WORDS})) AS BIGINT)"
    return found.select(
        "doc_id", "n_units", "n_removed",
        F.expr(passages.format("removed")).alias("n_passages"), F.expr(passages.format("shared")).alias("n_shared"),
        F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("removed_chars"),
        F.expr("array_join(transform(removed, x -> concat_ws(':', x.start, x.end, x.first_doc_id)), ',')").alias("removed"),
    )


def _oracle() -> str:
    spaces = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(translate(coalesce(text, ''), chr(1), ' '), chr(10)) AS l FROM documents),
i AS (SELECT k, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM d),
o AS (SELECT k, x, sum(length(x) + 1) OVER (PARTITION BY k ORDER BY i) - length(x) - 1 AS s FROM i),
p AS (SELECT k, s, string_split(regexp_replace(x, '([{MARKS}]+[ \x09\x0B-\x0D]+)', '\1' || chr(1), 'g'), chr(1)) AS c FROM o),
q AS (SELECT k, s, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM p),
r AS (SELECT k, x, s + sum(length(x)) OVER (PARTITION BY k, s ORDER BY i) - length(x) AS s FROM q),
w AS (SELECT k, s, s + length(rtrim(x, {spaces})) AS e, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM r),
g AS (SELECT k, s, e, array_to_string(w, ' ') AS t, row_number() OVER o AS g, sum(len(w)) OVER o AS b, sum(len(w)) OVER o - len(w) AS a FROM w WHERE len(w) > 0 WINDOW o AS (PARTITION BY k ORDER BY s)),
z AS (SELECT k, list(s ORDER BY g) AS s, list(e ORDER BY g) AS e, list(t ORDER BY g) AS t, list(a ORDER BY g) AS a, list(b ORDER BY g) AS b FROM g GROUP BY k),
v AS (SELECT DISTINCT k, i, j FROM (
  SELECT k, i, i + len(list_filter(b[i:], lambda y: y - a[i] < {MIN_WORDS})) AS j, len(b) AS n FROM (SELECT k, a, b, unnest(range(1, len(b) + 1)) AS i FROM z)
  UNION ALL SELECT k, len(list_filter(a, lambda y: b[len(b)] - y >= {MIN_WORDS})) AS i, len(b) AS j, len(b) AS n FROM z) WHERE j <= n AND i >= 1),
u AS (SELECT k, doc_id, i, j, s[i] AS s, e[j] AS e, array_to_string(t[i:j], ' ') AS t FROM v JOIN z USING (k) JOIN d USING (k)),
f AS (SELECT *, row_number() OVER o AS r, first_value(doc_id) OVER o AS f, min(k) OVER (PARTITION BY t) <> max(k) OVER (PARTITION BY t) AS shared FROM u WINDOW o AS (PARTITION BY t ORDER BY doc_id, k, s, e)),
x AS (SELECT k, kind, i, j, f, CASE WHEN i > max(j) OVER (PARTITION BY k, kind ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new
  FROM (SELECT k, 'goes' AS kind, i, j, f FROM f WHERE r > 1 UNION ALL SELECT k, 'shared', i, j, f FROM f WHERE shared)),
y AS (SELECT *, sum(new) OVER (PARTITION BY k, kind ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS h FROM x),
m AS (SELECT k, kind, min(i) AS i, max(j) AS j, arg_min(f, i * 1000000 + j) AS f FROM y GROUP BY k, kind, h),
n AS (SELECT k, kind, s[i] AS s, e[j] AS e, b[j] - a[i] AS n, f FROM m JOIN z USING (k)),
c AS (SELECT k, count(*) AS n_units, count(*) FILTER (r > 1) AS n_removed FROM f GROUP BY k),
a AS (SELECT k, count(*) FILTER (kind = 'goes' AND n >= {PASSAGE_WORDS}) AS n_passages, count(*) FILTER (kind = 'shared' AND n >= {PASSAGE_WORDS}) AS n_shared, sum(e - s) FILTER (kind = 'goes') AS c,
  string_agg(concat_ws(':', CAST(s AS BIGINT), CAST(e AS BIGINT), f), ',' ORDER BY s) FILTER (kind = 'goes') AS x FROM n GROUP BY k)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_passages, 0) AS n_passages, coalesce(n_shared, 0) AS n_shared,
  CAST(coalesce(c, 0) AS BIGINT) AS removed_chars, coalesce(x, '') AS removed FROM d LEFT JOIN c USING (k) LEFT JOIN a USING (k)
"""


ORACLE = _oracle()
