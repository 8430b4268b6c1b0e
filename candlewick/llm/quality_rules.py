r"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are SQL expressions over the whole text; words are [^\x20\x09-\x0D]+. Each rule bounds one ratio of them,
and a row is kept if no rule fails. There are no Python functions and no exchange: the plan is scan and projection.

Defined results: a null text counts as empty; an empty text has measures of 0 and fails by its length; the stop-word ratio of
fewer than 30 words tells nothing and counts as 1.
Rows are judged one by one, so repeated rows, ties and extra columns change nothing; an empty table gives an empty table.
Very long texts are measured whole, in time that grows with their words (and their logarithm, where windows repeat).
Repeated windows are found by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm._shared import free_name, table

SPACES = r" \t\n\x0B\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent words of the four languages, as they count for the stop-word ratio.
STOP_WORDS = (
    "the of and to a in that is for on with as by it this from are be was at or an which not "
    "de la le les et des en un une que qui dans pour sur par du au est pas plus ne se ce avec "
    "der die das und den von zu mit sich ist im nicht ein eine als auch es dem auf für "
    "el los las del y lo una por con para su al como no si o"
).split()


@dataclass(frozen=True)
class Rule:
    """The ratio must lie from low to high; None leaves a side open."""

    ratio: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> str:
        sides = [f"{self.ratio} < {self.low}D"] * (self.low is not None) + [f"{self.ratio} > {self.high}D"] * (self.high is not None)
        return f"({' OR '.join(sides)})"


#: Ratios that the rules may bound, by the measures below.
RATIOS = {
    "mean_word_chars": "IF(n_words = 0, 0D, word_chars / n_words)",
    "symbol_ratio": "IF(n_words = 0, 0D, n_symbols / n_words)",
    "stop_ratio": "IF(n_words < 30, 1D, n_stop / n_words)",
    "dup_line_ratio": "IF(n_lines = 0, 0D, n_dup_lines / n_lines)",
    "reuse_ratio": "IF(n_words = 0, 0D, 1D - n_distinct / n_words)",
}
RULES = (
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.2),
    Rule("stop_ratio", low=0.05),
    Rule("dup_line_ratio", high=0.4),
    Rule("reuse_ratio", high=0.8),
)


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once for a row wherever name stands in a lambda."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated(w: str) -> str:
    """Words of w in windows that w holds twice or more: sorts the windows' hashes with their places and sums what equal neighbours cover."""
    n = WINDOW
    words = ", ".join(f"{w}[p + {k}]" if k else f"{w}[p]" for k in range(n))
    twice = "filter(s, (x, j) -> (j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h))"
    covered = f"aggregate(array_sort(transform({twice}, x -> x.p)), named_struct('c', 0L, 'e', 0L), (a, p) -> named_struct('c', a.c + p + {n} - greatest(a.e, CAST(p AS BIGINT)), 'e', CAST(p + {n} AS BIGINT)), a -> a.c)"
    with_places = _let("s", "sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))", covered)
    hashes = f"transform(sequence(0, size({w}) - {n}), p -> xxhash64({words}))"
    return f"IF(size({w}) < {n}, 0L, {_let('h', hashes, f'IF(size(array_distinct(h)) = size(h), 0L, {with_places})')})"


def measures(text: str) -> Column:
    """A struct of counts of the text in a column."""
    quoted = ", ".join(f"'{x}'" for x in STOP_WORDS)
    counts = ", ".join(
        [
            "'n_words', CAST(size(w) AS BIGINT)",
            "'word_chars', aggregate(w, 0L, (a, x) -> a + length(x))",
            f"'n_symbols', CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT)",
            "'n_lines', CAST(size(l) AS BIGINT)",
            "'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT)",
            f"'n_repeat_words', {_repeated('w')}",
            "'n_distinct', CAST(size(array_distinct(w)) AS BIGINT)",
            f"'n_stop', CAST(size(filter(w, x -> lower(rtrim('.,;:!?%*$&#', x)) IN ({quoted}))) AS BIGINT)",
        ]
    )
    lines = rf"filter(split(t, '\\n'), x -> btrim(x, '{SPACES.replace('\\x0B', '\\u000B').replace('\\f', '\\u000C')}') <> '')"
    words = r"filter(split(t, '[ \\x09-\\x0D]+'), x -> x <> '')"
    return F.expr(_let("t", f"coalesce(`{text.replace('`', '``')}`, '')", _let("w", words, _let("l", lines, f"named_struct({counts})"))))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, verdict: str = "method_kept") -> DataFrame:
    """Adds the measures, the ratios, the failed rules' names and the verdict to docs.

    A column of docs by one of these names is replaced.
    """
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stop")
    found = free_name(docs.columns, "measures")
    made = docs.withColumn(found, measures(text))
    made = made.withColumns({x: F.col(f"{found}.{x}") for x in fields}).drop(found)
    made = made.withColumns({k: F.expr(v) for k, v in RATIOS.items()})
    failed = F.expr("filter(array(" + ", ".join(f"IF({r.failed()}, '{r.ratio}', NULL)" for r in rules) + "), x -> x IS NOT NULL)") if rules else F.expr("CAST(array() AS array<string>)")
    return made.withColumn("failed_rules", F.array_join(failed, ",")).withColumn(verdict, F.col("failed_rules") == "")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = judged.withColumn("base_failed", F.expr(f"n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr("NOT base_failed AND method_kept").alias("kept"), "failed_rules",
    )


def _oracle() -> str:
    quoted = ", ".join(f"'{x}'" for x in STOP_WORDS)
    ratios = {k: v.replace("IF(", "if(").replace("0D", "0.0").replace("1D", "1.0") for k, v in RATIOS.items()}
    failed = ", ".join(f"CASE WHEN {r.failed().replace('D)', ')').replace('D ', ' ')} THEN '{r.ratio}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, p, array_to_string(w[p + 1:p + {WINDOW}], ' ') AS g FROM (SELECT k, unnest(range(0, len(w) - {WINDOW - 1})) AS p, w FROM w WHERE len(w) >= {WINDOW})),
h AS (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS c FROM g),
r AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + {WINDOW})) AS q FROM h WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS wc,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct,
             len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?%*$&#')) IN ({quoted}))) AS n_stop FROM w LEFT JOIN r USING (k)),
v AS (SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_stop FROM m),
x AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in ratios.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v),
y AS (SELECT *, array_to_string(list_filter([{failed}], lambda z: z IS NOT NULL), ',') AS failed_rules FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(failed_rules, '') = '' AS kept, coalesce(failed_rules, '') AS failed_rules FROM y
"""


ORACLE = _oracle()
