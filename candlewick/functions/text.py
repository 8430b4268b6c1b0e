"""Column functions over text: stripping, sentences, headings, labels. All run inside the JVM but split_sentences()."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it: Unicode's, and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
#: Marks that end a sentence (the last is the danda, U+0964).
SENTENCE_END = ".!?\u0964"
#: Words before a number that make a heading (the last two are Tamil for chapter and lesson), and limits.
HEADING_WORDS = ("chapter", "unit", "section", "அத்தியாயம்", "பாடம்")
HEADING_CHARS = 90
CAPITAL_WORDS = (3, 12)


def let(value: Column, body) -> Column:
    """body of the value, which is computed once a row however often body mentions it.

    A lambda's argument isn't inlined, so the optimizer can't copy an array's expression into each lambda that uses it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def sentences(text: Column) -> Column:
    """Stripped sentences that aren't empty: cut after an end mark and white space, or at two or more line breaks."""
    parts = F.split(text, rf"(?U)(?<=[{SENTENCE_END}]){SPACE}+|\n{{2,}}", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


_CUTS = re.compile(rf"(?<=[{SENTENCE_END}])\s+|\n{{2,}}")


def split_sentences(text: str) -> list[str]:
    """sentences() for one text, in Python."""
    return [x for x in (part.strip() for part in _CUTS.split(text)) if x]


def required(text: Column, what: str = "text") -> Column:
    """The text; a blank one raises."""
    return F.when(is_blank(text), F.raise_error(F.lit(f"{what} is blank"))).otherwise(text)


def looks_like_heading(line: Column) -> Column:
    """A short line that numbers a chapter, is numbered and capitalised, or is some words of capitals."""

    def of(x: Column) -> Column:
        words = F.size(F.split(x, rf"(?U){SPACE}+"))
        numbered = x.rlike(rf"(?iU)\A({'|'.join(HEADING_WORDS)}){SPACE}+\d")
        titled = x.rlike(rf"\A(?U:\d+(\.\d+)*{SPACE}+)[A-Z][a-zA-Z ]{{3,60}}\z")
        capitals = x.rlike(r"\p{IsUppercase}") & ~x.rlike(r"[\p{IsLowercase}\p{Lt}]") & words.between(*CAPITAL_WORDS)
        return (x != "") & (F.length(x) <= HEADING_CHARS) & (numbered | titled | capitals)

    return F.coalesce(let(strip(line), of), F.lit(False))


def location_label(source_file: Column, heading: Column, page_number: Column) -> Column:
    """file › heading (page n), without what is empty; page 0 is none."""
    page = F.when(page_number != 0, F.concat(F.lit(" (page "), page_number.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.concat_ws(" › ", source_file, F.nullif(heading, F.lit(""))), page)


def best_text(highlight: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(highlight, F.lit("")), text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=[^.])(\.[^./]*)$", 1))


#: What an answer says where nothing was found.
NO_RESULT = "Nothing relevant to that question was found in the index."


def rendered(rank: Column, label: Column, score: Column, text: Column) -> Column:
    return F.concat(F.format_string("#%d — %s · similarity %.3f\n", rank, label, score), text)
