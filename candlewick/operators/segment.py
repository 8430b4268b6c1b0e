"""Lines of files into text blocks under headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.text import strip


def segment(lines: DataFrame, heading: str = "is_heading") -> DataFrame:
    """file, page, heading, text and block_pos (from 0 in its file) of lines (file, page, line_no, line, is_heading).

    A heading line ends the block before it, belongs to no block and names those that follow, across pages; a page's
    end ends a block too. Lines of a block are joined by line breaks and stripped; blocks without text go. A heading
    without lines of its own leaves no trace. Rows are dealt by file, the unit of order.
    """
    w = Window.partitionBy("file").orderBy(F.col("page").asc_nulls_first(), "line_no")
    marked = lines.select(
        "file", "page", "line_no", "line", F.col(heading).alias("h"),
        F.sum(F.col(heading).cast("int")).over(w).alias("section"),
        F.coalesce(F.last(F.when(F.col(heading), strip(F.col("line"))), True).over(w), F.lit("")).alias("heading"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = strip(F.array_join(F.transform(ordered, lambda x: x.line), "\n"))
    blocks = marked.where("NOT h").groupBy("file", "page", "section", "heading").agg(text.alias("text")).where("text <> ''")
    place = Window.partitionBy("file").orderBy(F.col("page").asc_nulls_first(), "section")
    return blocks.select("file", "page", "heading", "text", (F.row_number().over(place) - 1).alias("block_pos"))
