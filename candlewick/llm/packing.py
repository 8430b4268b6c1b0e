"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Round 0, one pass over the texts: each partition tokenises its documents, packs the pieces best-fit and closes bins
that are nearly full. All others stay open to the partition's later pieces: its task holds the numbers of their pieces,
not ids. Later rounds: the underfull bins of FAN neighbouring groups meet in one task, where each bin is
an item of its own length and is packed best-fit again, up to a single group. A group hands on at most CARRY bins, the
emptiest; fuller ones beyond are closed as they are, so no later task grows with the input and no piece is lost.

Only the bins that move on are shuffled, with their pieces' numbers, never texts or ids. Each round is written to the
shared folder, so its numbering is fixed and a lost executor costs one task.

Defined results: a null text is empty and gives one piece of one id, the separator; repeated rows are packed each by
itself; ties in length are packed in the order read. Very long texts are tokenised whole and cut into full pieces. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm._shared import Scratch, lean, memories, table

CAPACITY = 2048
SEPARATOR = 0
#: A bin with at most so many free places is closed at once.
SLACK = 8
#: Underfull bins that a group hands to the next round.
CARRY = 256
#: Groups that meet in one.
FAN = 8
#: Pieces that are packed together in round 0, at least.
BUFFER = 50_000

_WS = r" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{_WS}]+|[^{_WS}]+")


#: Marks that a word may end with. A run of them is a token of its own before BPE, if a letter stands before it.
_MARKS = ".,;:!?%*$&#|)"
#: The printable character by which a byte-level tokenizer's model names each byte.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class _Units(dict):
    """Ids, as bytes, of a text without white space inside, with or without the space before it."""

    def __init__(self, tokenizer, before: str, most: int):
        self.tokenizer, self.model, self.before, self.most = tokenizer, tokenizer.model, before, most
        self.ends: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        head = unit.rstrip(_MARKS)
        if head and head.isalpha() and max(head) < "\u0250":  # one token before BPE, in any version of Unicode
            if len(head) < len(unit):
                value = self[head] + self.end(unit[len(head) :])
            else:
                named = (self.before + head).encode().decode("latin-1").translate(_BYTE_NAMES)
                value = array("I", [x.id for x in self.model.tokenize(named)]).tobytes()
        else:
            value = self.whole(self.before + unit)
        if len(unit) <= 100:
            if len(self) >= self.most:
                self.clear()
            self[unit] = value
        return value

    def end(self, marks: str) -> bytes:
        if len(marks) > 4:
            return self.whole(marks)
        if marks not in self.ends:
            self.ends[marks] = self.whole(marks)
        return self.ends[marks]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer.

    Such a tokenizer never merges across the border before the last white space ahead of a word, so a text's ids are
    those of its words joined, and words come back often. The memory of words is bounded by most.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.plain, self.spaced = _Units(tokenizer, "", most // 4), _Units(tokenizer, " ", most)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        plain, spaced, out = self.plain, self.spaced, []
        words = text.split()
        if len(words) - 1 == text.count(" ") + text.count("\n") == len(text) - len("".join(words)):  # single spaces and line breaks between words
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if k:
                    out.append(plain["\n"])
                if first:
                    out.append(plain[first])
                out += map(spaced.__getitem__, rest)
            return b"".join(out)
        runs = _RUNS.findall(text)
        before = ""
        for k, run in enumerate(runs):
            if run[0] not in _SPACES:
                out.append(spaced[run] if before else plain[run])
                before = ""
            elif k == len(runs) - 1:
                out.append(plain[run])
            else:
                before = " " if run[-1] == " " else ""
                out += [plain[x] for x in ((run[:-1],) if before else (run[:-1], run[-1])) if x]
        return b"".join(out)


_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c))
_encoders: dict[str, Encoder] = {}
memories["ids"] = _encoders


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document of n ids: whole, or cut from its end into full pieces, the first the rest."""
    if n <= capacity:
        return [(0, n)]
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Packs (length, members), longest first, each into the bin that it leaves fullest; (filled, members) of the bins."""
    free: list[list[list]] = [[] for _ in range(capacity + 1)]
    bins, mask = [], 0
    for length, members in sorted(items, key=lambda x: -x[0]):
        if fits := mask >> length:
            room = length + (fits & -fits).bit_length() - 1
            into = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            into[1] += members
        else:
            room, into = capacity, [0, list(members)]
            bins.append(into)
        into[0] += length
        free[room - length].append(into)
        mask |= 1 << (room - length)
    return [(filled, members) for filled, members in bins]


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = "sequence_id long, grp long, done boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _rows(round_no: int, group: int, closed: list, open_: list, first: int = 0) -> pa.RecordBatch:
    """Bins as rows; sequence_id holds round, group and number, so it is unique."""
    bins = closed + open_
    flat, offsets = [], [0]
    for _, members in bins:
        at = 0
        for m in members:
            flat.append((*m[:5], at))
            at += m[3]
        offsets.append(len(flat))
    fields = [pa.array([m[i] for m in flat], MEMBER[i].type) for i in range(MEMBER.num_fields)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([round_no << 57 | group << 25 | first + k for k in range(len(bins))], pa.int64()),
            pa.array([group] * len(bins), pa.int64()),
            pa.array([True] * len(closed) + [False] * len(open_), pa.bool_()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(MEMBER))),
        ],
        names=["sequence_id", "grp", "done", "members"],
    )


def _split(bins: list, capacity: int, carry: int | None) -> tuple[list, list]:
    """Bins to close and bins that go on: the underfull, of these at most carry (all if None), the emptiest."""
    done = [b for b in bins if b[0] >= capacity - SLACK]
    rest = sorted((b for b in bins if b[0] < capacity - SLACK), key=lambda b: b[0])
    if carry is None:
        return done, rest
    return done + rest[carry:], rest[:carry]


def _first_round(path: str, capacity: int, separator: int):
    end = separator.to_bytes(4, "little")  # as array("I") has them on the machines that Spark runs on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, encoder, items, number, most = TaskContext.get().partitionId(), _encoder(path), [], 0, BUFFER
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    items.append((n, [(doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))]))
                if len(items) >= most:
                    # what stays open is packed again with the pieces to come, as many as are open at least
                    closed, items = _split(best_fit(items, capacity), capacity, None)
                    most = max(BUFFER, 2 * len(items))
                    yield _rows(0, group, closed, [], number)
                    number += len(closed)
        closed, open_ = _split(best_fit(items, capacity), capacity, CARRY)
        yield _rows(0, group, closed, open_, number)

    return run


def _later_round(round_no: int, capacity: int, last: bool):
    def run(key: tuple, bins: pa.Table) -> pa.Table:
        items = []
        for members in bins.column("members").to_pylist():
            found = [tuple(m.values()) for m in members]
            items.append((sum(m[3] for m in found), found))
        closed, open_ = _split(best_fit(items, capacity), capacity, 0 if last else CARRY)
        return pa.Table.from_batches([_rows(round_no, key[0].as_py(), closed, open_)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_first_round(tokenizer_path, capacity, separator), "ids"), BINS)
    rounds = [scratch.keep(made, "round0")]
    groups = (rounds[0].agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // FAN)
        open_ = rounds[-1].where("NOT done").withColumn("grp", F.expr(f"grp DIV {FAN}"))
        merged = open_.groupBy("grp").applyInArrow(_later_round(len(rounds), capacity, groups == 1), BINS)
        rounds.append(scratch.keep(merged, f"round{len(rounds)}"))
        if groups == 1:
            break
    done = rounds[0].where("done")
    for r in rounds[1:]:
        done = done.unionByName(r.where("done"))
    return done.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
