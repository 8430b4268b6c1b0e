r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus-digit pairs, URL schemes and identifier cues.
From each anchor a local parser expands to the item's bounds and validates it (ranges, digit counts, check digits).
Kinds, in order: email, ip, card, phone, then what the method adds: url, account, secret. Within a kind spans are
leftmost and apart: an item that fails validation uses up its text and is not tried again.

Positions are code points, ends exclusive. Defined results: a null text is empty and has no spans; repeated rows are
judged one by one; of spans of one kind the leftmost counts, spans of several kinds at one place are all given; other
columns stay as they are (a column named spans is replaced); an empty table gives none. Very long texts are read whole,
in time that grows with their length. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm._shared import lean, table

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "routing")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
#: What may stand between a cue and its number.
_CUED = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|code|is|#|:|=))*\s*", re.I)
_END = r"(?![A-Za-z0-9])"
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*", re.I)
_GROUPED = re.compile(rf"[0-9]{{2,4}}(?: [0-9]{{2,4}}{_END})+")
_TOKEN = re.compile(rf"[A-Z]{{0,2}}[0-9][A-Z0-9]*(?:-[A-Z]*[0-9][A-Z0-9]*)*{_END}", re.I)
_SECRET = re.compile(r"\s*[:=]\s*([\"']?)([A-Za-z0-9_./+=-]{12,})\1")


def luhn(digits: str) -> bool:
    doubled = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if c in _DIGITS])


def iban(text: str) -> bool:
    """Whether length and check digits are those of an international bank account number, in groups that hold digits (the
    second, which may name a bank, needn't)."""
    if not all(any(c in _DIGITS for c in x) for k, x in enumerate(text.split(" ")) if k != 1):
        return False
    text = text.replace(" ", "").upper()
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def account(text: str, at: int) -> tuple[int, int, bool] | None:
    """Start, end and validity of the number after a cue that ends at a place.

    A bank account number by its check digits, groups of two to four digits with a space between, or one word that holds
    digits, whose parts between hyphens each hold one. A word without digits is never taken in.
    """
    at = _CUED.match(text, at).end()
    if m := _IBAN.match(text, at, at + 50):
        ends = [e for e in range(at + 15, m.end() + 1) if not text[e - 1].isspace() and not text[e : e + 1].isalnum()]
        if found := [e for e in ends if iban(text[at:e])]:
            return at, found[-1], True
    for pattern in (_GROUPED, _TOKEN):
        if m := pattern.match(text, at):
            if len(_digits(m[0])) >= 6 or pattern is _TOKEN:
                return at, m.end(), 6 <= len(_digits(m[0])) and len(m[0]) <= 34
    return None


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        words = {"@": "email"} | {d: "digit" for d in _DIGITS} | {f"+{d}": "phone" for d in _DIGITS}
        for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            words |= {form: kind for cue in cues for form in (cue, cue.upper(), cue.capitalize())}
        for word, kind in words.items():
            self.anchors.add_word(word, (len(word), kind))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end), in order."""
        found, free = [], dict.fromkeys(KINDS, 0)

        def add(kind: str, start: int, end: int, valid: bool = True) -> None:
            free[kind] = end
            if valid:
                found.append((start, KINDS.index(kind), end))

        for last, (length, kind) in self.anchors.iter(text):
            at = last - length + 1
            if kind == "digit":
                if at >= free["card"] and (m := _CARD.match(text, at)):
                    digits = _digits(m[0])
                    add("card", at, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
                # a later start within a run of digits meets the same parts as the run's first
                if at >= free["ip"] and (at == free["ip"] or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                    add("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")))
            elif kind == "email":
                start = at
                while start > free["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    add("email", start, m.end())
            elif kind == "phone":
                if at >= free["phone"] and (m := _PHONE.match(text, at)):
                    add("phone", at, m.end(), 9 <= len(_digits(m[0])) <= 15)
            elif at >= free[kind]:
                if kind == "url":
                    if m := _URL.match(text, last + 1):
                        body = m[0].rstrip(".,;:!?)]*&%#$")
                        add("url", at, last + 1 + len(body), "." in body.split("/")[0].strip("."))
                elif kind == "account":
                    if not (at and text[at - 1].isalnum()) and (found_at := account(text, last + 1)):
                        add("account", *found_at)
                elif m := _SECRET.match(text, last + 1):
                    add("secret", m.start(2), m.end(2), any(c in _DIGITS for c in m[2]))
        return sorted(found)


_finder: list[Finder] = []


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    if not _finder:
        _finder.append(Finder())
    return _finder[0].spans(text) if text else []


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans, an array of (kind, start, end) by start, to docs."""
    docs = docs.drop("spans")
    at, names = docs.columns.index(text), [*docs.columns, "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(x.as_py())] for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    return docs.mapInArrow(lean(run, None), T.StructType([*docs.schema.fields, T.StructField("spans", SPANS)]))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark in place of each span; of spans that overlap, one mark for all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with marks in place of personal data; null texts stay null, other columns as they are."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(at).to_pylist()
            columns[at] = pa.array([x and masked(x, spans_of(x)) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run, None), docs.schema)


def op4_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{k}'" for k in BASE)
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined.format(f"filter(spans, x -> x.kind IN ({base}))")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        *[F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS[4:]],
        F.expr("CAST(size(filter(spans, x -> x.kind <> 'url')) AS BIGINT)").alias("n_private"),
    )
