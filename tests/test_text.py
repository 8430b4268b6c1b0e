import re

import pytest
from pyspark.sql import functions as F

from candlewick.functions import text as ft


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}" if isinstance(kind, str) else kind)
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def reference_split(text):
    """The rule in plain Python, as a third check beside Spark and SQL."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?।])\s+|\n{2,}", text)) if s]


CASES = [
    "One. Two! Three?", "अर्थ एक। अर्थ दो।", "", "  \n ", "no end", "a\n\nb", "a\nb. c", "a.\x1cb", "a. b.　c", "e.g.x", "...  ! x", "a. \n\n b", "x\n\n\n\ny",
]


def test_sentences_equal_the_rule(spark):
    assert column(spark, CASES, ft.sentences) == [reference_split(x) for x in CASES]


HEADINGS = {
    "Chapter 3": True, "chapter 12abc": True, "UNIT  4 Motion": True, "Section": False, "அத்தியாயம் 2": True, "பாடம் 5": True, "1.2 Laws of Motion": True, "1.2 laws of motion": False,
    "3 Ab": False, "THE LAWS OF MOTION": True, "THE LAWS": False, "A B C D E F G H I J K L": True, "A B C D E F G H I J K L M": False, "The LAWS OF": False, "": False, "   ": False,
    "CHAPTER 1 " + "X" * 90: False, "  CHAPTER 9  ": True, "12 34 56": False, "A1 B2 C3": True, "ǅ AB CD": False,
}


def test_headings(spark):
    assert dict(zip(HEADINGS, column(spark, list(HEADINGS), ft.looks_like_heading))) == HEADINGS


@pytest.mark.parametrize(
    ("heading", "page", "label"), [("Laws", 3, "b.pdf › Laws (page 3)"), ("", None, "b.pdf"), ("Laws", None, "b.pdf › Laws"), ("", 0, "b.pdf"), ("", 2, "b.pdf (page 2)")]
)
def test_location_label(spark, heading, page, label):
    row = spark.createDataFrame([("b.pdf", heading, page)], "f string, h string, p int")
    assert row.select(ft.location_label(F.col("f"), F.col("h"), F.col("p"))).first()[0] == label


def test_best_text_blank_and_paths(spark):
    row = spark.createDataFrame([("", "t"), ("h", "t")], "h string, t string")
    assert [r[0] for r in row.select(ft.best_text(F.col("h"), F.col("t"))).collect()] == ["t", "h"]
    assert column(spark, ["", " \t\x1f", None, "x"], ft.is_blank) == [True, True, True, False]
    assert column(spark, ["/a/b.PDF", "c.docx", "/x.y/z", ".pdf", "a.b.DocX"], ft.extension) == [".pdf", ".docx", "", "", ".docx"]
    assert column(spark, ["/a/b.pdf", "c"], ft.basename) == ["b.pdf", "c"]
