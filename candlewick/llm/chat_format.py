"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, then its turns are rendered alike.

A text is cut into segments at lines that begin with a speaker marker (User:, ### Assistant, <|system|>, ...). States
are the roles; a segment's features are its marker, whether it opens the conversation, whether it opens its row, its
length, its lines and a closing question mark. Emissions and transitions are counted over all labelled rows of one
segment outside a held-out fold; of a marker MARKED more are counted for the role that it names, as tables without
transcripts tell nothing of markers, and each role's shares lean on those of all. Roles are decoded by Viterbi. Labels are never inputs of decoding.

What is dealt by range of (conv_id, turn) are features, not texts, so a conversation of any size spreads over many
blocks of at most BLOCK rows. Viterbi is a product of max-plus matrices, hence exact in blocks: a block gives the matrix
of the conversation that enters it and of the one that leaves it; the few that span blocks are joined by their matrices,
a row for each block; then each block is decoded with the roles at its ends given. Roles go back to the rows by conv_id,
turn and a hash of the text, the one shuffle of texts, and each row is cut again and rendered. Only counts, of at most
some thousand kinds, and two rows a partition reach the driver.

Defined results: null and empty texts are one segment without text; rows of one conversation and turn are ordered by a
hash (128 bits) of their text; a row that comes again is the same one, decoded once, and gives its turns each time; a
null conv_id is a conversation of its own kind, a null turn comes first; with no labels all roles are as likely; of roles
equally likely the first of ROLES is taken. Very long texts are cut whole. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm._shared import Scratch, lean, table

ROLES = ("system", "user", "assistant")
#: Names by which transcripts mark speakers.
MARKERS = {"system": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "question": 1, "prompter": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "gpt": 2}
_NAMES = "|".join(sorted(MARKERS, key=len, reverse=True))
#: A name with a colon, in brackets or bars, or alone in a line that number signs open.
_MARKER = re.compile(
    rf"^[ \t]*(?:#+[ \t]*(?P<heading>{_NAMES})[ \t]*(?::|$)|(?:\*\*|<\|(?:im_start\|>)?|\[)?(?P<name>{_NAMES})[ \t]*(?::\*\*|\*\*:|\|>|\]|:)|<\|im_start\|>(?P<opened>{_NAMES})[ \t]*$)[ \t]*", re.I | re.M
)
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
#: Segments that are counted for a marker beside those of the table, and for a role with the shares of all.
MARKED, SMOOTH = 1_000_000, 20
#: Rows of a block.
BLOCK = 20_000

_KEYS = ("conv_id", "turn", "t1", "t2")
ROWS = "conv_id long, turn long, t1 long, t2 long, segments array<array<int>>, role int"


def segments(text: str | None) -> list[tuple[int, str]]:
    """Marker (a role's number, or -1) and text of each segment."""
    text = text or ""
    found = [*_MARKER.finditer(text)]
    cuts = [m.start() for m in found]
    out = [(-1, text[: cuts[0]].strip("\n"))] if found and text[: cuts[0]].strip() else [] if found else [(-1, text)]
    for m, end in zip(found, [*cuts[1:], len(text)]):
        out.append((MARKERS[m[m.lastgroup].lower()], text[m.end() : end].strip("\n")))
    return out


def features(marker: int, first: bool, opens: bool, text: str) -> list[int]:
    return [marker + 1, int(first), int(opens), len(text).bit_length(), min(text.count("\n"), 7), int(text.rstrip().endswith("?"))]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, the features of each row's segments, and its role if it is known and the row has one segment."""
    for batch in batches:
        found, roles = [], []
        for turn, text, role in zip(batch.column(1).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
            own = segments(text.as_py())
            found.append([features(marker, turn == 0 and not k, not k, part) for k, (marker, part) in enumerate(own)])
            roles.append(ROLES.index(role) if role in ROLES and len(own) == 1 else -1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(roles, pa.int32())], names=[*_KEYS, "segments", "role"])


def _numbered(size: int):
    """Adds part, block, place, and the conversation and role of the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, (None, -2)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = [before, *zip(batch.column(0).to_pylist(), batch.column(5).to_pylist())]
            before = rows.pop()
            places = range(at, at + n)
            columns = [pa.array([part] * n, pa.int32()), pa.array([part << 32 | k // size for k in places], pa.int64()), pa.array(places, pa.int64())]
            columns += [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "block", "place", "before_id", "before_role"])
            at += n

    return run


class Model:
    """Log probabilities of features by role and of a role after another (or at the start, the last row)."""

    def __init__(self, emitted: Counter, moved: Counter):
        self.emitted: list[dict[int, np.ndarray]] = []
        for k in range(len(features(-1, False, False, ""))):
            counts = {v: np.zeros(len(ROLES)) for v in sorted({x[k] for x, _ in emitted} | set(range(len(ROLES) + 1) if k == 0 else ()))}
            for (x, role), n in emitted.items():
                counts[x[k]][role] += n
            if k == 0:
                self.emitted.append(self._marked(counts))
                continue
            # a role's shares lean on those of all, so that a role that was never seen is as likely as any
            total, every = sum(counts.values(), np.zeros(len(ROLES))), sum(c.sum() for c in counts.values())
            self.emitted.append({v: np.log((c + SMOOTH * (c.sum() + 1) / (every + len(counts))) / (total + SMOOTH)) for v, c in counts.items()})
        self.moved = np.ones((len(ROLES) + 1, len(ROLES)))
        for (a, b), n in moved.items():
            self.moved[a, b] += n
        self.moved = np.log(self.moved / self.moved.sum(axis=1, keepdims=True))

    @staticmethod
    def _marked(counts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of markers: whether there is one, and then which."""
        none, marks = counts[0], {r + 1: counts[r + 1] + 1 + MARKED * (np.arange(len(ROLES)) == r) for r in range(len(ROLES))}
        seen = none + sum(counts[r + 1] for r in range(len(ROLES)))
        absent = (none + SMOOTH / 2) / (seen + SMOOTH)
        return {0: np.log(absent)} | {v: np.log((1 - absent) * m / sum(marks.values())) for v, m in marks.items()}

    def emission(self, x: list[int]) -> np.ndarray:
        return sum((seen[v] for v, seen in zip(x, self.emitted) if v in seen), np.zeros(len(ROLES)))

    def step(self, x: list[int]) -> np.ndarray:
        """Max-plus matrix from the role before to this segment's."""
        return self.moved[: len(ROLES)] + self.emission(x)[None, :]

    def start(self, x: list[int]) -> np.ndarray:
        return self.moved[len(ROLES)] + self.emission(x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def viterbi(model: Model, xs: list[list[int]], before: int | None, last: int | None) -> list[int]:
    """Roles of the segments, given the role before them (None: they open the conversation) and of the last."""
    score = model.start(xs[0]) if before is None else model.step(xs[0])[before]
    back = []
    for x in xs[1:]:
        ways = score[:, None] + model.step(x)
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _parts(rows: pa.Table) -> list[tuple[int | None, list[dict]]]:
    """The conversations of a block, in order."""
    listed = rows.sort_by("place").to_pylist()
    return [(conv, list(part)) for conv, part in groupby(listed, key=lambda r: r["conv_id"])]


def _counted(held_out):
    """For a block: counts of emissions and moves, from the row before the block too."""

    def run(rows: pa.Table) -> pa.Table:
        counts = Counter()
        for r in rows.to_pylist():
            if r["role"] < 0 or held_out(r["conv_id"]):
                continue
            (x,) = r["segments"]
            counts["emit", ",".join(map(str, x)), r["role"]] += 1
            if r["before_id"] == r["conv_id"] and r["before_role"] >= 0:
                counts["move", str(r["before_role"]), r["role"]] += 1
        out = [(*key, n) for key, n in counts.items()]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "key", "role", "n"])

    return run


def _crc(conv) -> bool:
    import zlib

    return zlib.crc32(str(conv).encode()) % 5 == 0


def train(rows: DataFrame, held_out=_crc) -> Model:
    """Counts over every labelled row outside the held-out fold."""
    counts = rows.where("role >= 0").groupBy("block").applyInArrow(_counted(held_out), "kind string, key string, role int, n long")
    emitted, moved = Counter(), Counter()
    for r in counts.groupBy("kind", "key", "role").agg(F.sum("n").alias("n")).collect():
        if r.kind == "emit":
            emitted[tuple(map(int, r.key.split(","))), r.role] += r.n
        else:
            moved[int(r.key), r.role] += r.n
    # from one partition to the next
    end = F.struct("conv_id", "role")
    ends = rows.groupBy("part").agg(F.min_by(end, "place").alias("first"), F.max_by(end, "place").alias("last")).orderBy("part").collect()
    for a, b in zip(ends, ends[1:]):
        if a.last.conv_id == b.first.conv_id and min(a.last.role, b.first.role) >= 0 and not held_out(a.last.conv_id):
            moved[a.last.role, b.first.role] += 1
    # the first segment of a conversation, by its own feature
    for (x, role), n in emitted.items():
        if x[1]:
            moved[len(ROLES), role] += n
    return Model(emitted, moved)


def _matrices(model: Model):
    """For a block: the matrix of its first and of its last conversation, which may go on in other blocks."""

    def run(rows: pa.Table) -> pa.Table:
        parts, block = _parts(rows), rows.column("block")[0].as_py()
        out = []
        for conv, part in parts[:1] + parts[1:][-1:]:
            first, *rest = [x for r in part for x in r["segments"]]
            # over the first row are the scores if the conversation opens here
            opened = np.vstack([model.start(first)[None, :], model.step(first)])
            for x in rest:
                opened = product(opened, model.step(x))
            out.append((conv, block, opened.ravel().tolist()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["conv_id", "block", "matrix"])

    return run


def _ends(rows: pa.Table) -> pa.Table:
    """For a conversation that spans blocks: the role before each block and its last role."""
    listed = rows.sort_by("block").to_pylist()
    shape = (len(ROLES) + 1, len(ROLES))
    score, back = None, []
    for r in listed:
        m = np.array(r["matrix"]).reshape(shape)
        if score is None:
            score = m[0]
        else:
            ways = score[:, None] + m[1:]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    columns = [[r["conv_id"] for r in listed], [r["block"] for r in listed], [None, *path[:-1]], path]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["conv", "at", "before", "last"])


DECODED = "conv long, at long, k1 long, k2 long, roles array<int>"


def _decoded(model: Model):
    """Keys and roles of the rows of a block."""

    def run(rows: pa.Table, ends: pa.Table) -> pa.Table:
        given = {r["conv"]: (r["before"], r["last"]) for r in ends.to_pylist()}
        out = []
        for conv, part in _parts(rows) if rows.num_rows else ():
            roles = iter(viterbi(model, [x for r in part for x in r["segments"]], *given.get(conv, (None, None))))
            out += [(conv, r["turn"], r["t1"], r["t2"], [next(roles) for _ in r["segments"]]) for r in part]
        types = (*[pa.int64()] * 4, pa.list_(pa.int32()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["conv", "at", "k1", "k2", "roles"])

    return run


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, turn, text, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            out += [(conv, turn, k, ROLES[r], TEMPLATE.format(role=ROLES[r], text=part)) for k, ((_, part), r) in enumerate(zip(segments(text.as_py()), roles))]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["conv_id", "turn", "segment", "role", "rendered"])


def render(conversations: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, segment, role and rendered of every segment of conversations (conv_id, turn, text; role to learn from)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    if "role" not in conversations.columns:
        conversations = conversations.withColumn("role", F.lit(None).cast("string"))
    text = F.col("text").cast("string")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"), F.col("role").cast("string")
    )
    made = rows.mapInArrow(lean(_featured), ROWS).groupBy(*_KEYS).agg(F.first("segments").alias("segments"), F.max("role").alias("role"))
    dealt = made.repartitionByRange(parts, *_KEYS) if parts else made.repartitionByRange(*_KEYS)
    placed = dealt.sortWithinPartitions(*_KEYS).mapInArrow(_numbered(block), f"{ROWS}, part int, block long, place long, before_id long, before_role int")
    kept = scratch.keep(placed, "rows")
    model = train(kept)
    matrices = kept.groupBy("block").applyInArrow(_matrices(model), "conv_id long, block long, matrix array<double>")
    # a conversation spans blocks if it has several matrices; a null id counts as one
    ends = matrices.groupBy("conv_id").applyInArrow(_ends, "conv long, at long, before int, last int")
    found = scratch.keep(kept.groupBy("block").cogroup(ends.groupBy("at")).applyInArrow(_decoded(model), DECODED), "roles")
    scratch.drop("rows")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("turn").eqNullSafe(F.col("at")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    return rows.join(found, same).select("conv_id", "turn", "text", "roles").mapInArrow(lean(_rendered), "conv_id long, turn long, segment int, role string, rendered string")


def op1_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))
