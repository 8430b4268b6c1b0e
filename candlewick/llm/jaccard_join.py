r"""Exact n-gram Jaccard self-join by a token-group matrix.

A document's tokens are the 64-bit hashes of its distinct word n-grams; equal sets are one node. Similar nodes are
partitioned into groups; the matrix has a row per group: the union of its nodes' tokens and its nodes' own, as counts by
ranges of token space (a byte a range, a range for every one or two tokens). The sum of the lesser counts bounds a
node's overlap with a union, and so with each node under it. Only groups that reach the threshold are opened: the
tokens of the nodes that reach each other are made from their texts, sent to the group and compared.

Which groups a node is held against comes from signatures that no link can miss. Two sets of which the smaller has s
tokens and that link differ in at most k = s (1 - t) / t tokens. Token space is cut into somewhat over k ranges; of a
set's non-empty ranges more than k hold, so at least one is equal in both sets, and so is the hash of its tokens.
Sizes are dealt into levels, a set signs at its own and at those a linked smaller set may have. Sets with too few
non-empty ranges sign again under further seeds, the last time with empty ranges too. A signature of many
nodes, as a passage in many documents makes, is left out by each set that has over k others: of these too at least one
is equal in any set that it links with.

Passes: (1) id, node and counts of every document; (2) signatures, packed by reducer, of which those that differing
nodes share are kept; (3) groups by least similar node, each held against itself, which gives components; (4) for
signatures that still span several components, groups dealt anew by component, and the smaller of two that meet asks
the larger. Links only join components: no group or bucket gives all its pairs, what is joined already isn't compared
again, and what travels for a candidate is its counts, not its tokens.

Defined results: null and empty texts have no tokens and link with nothing; equal texts are one node, however many;
ids may repeat or be null (a component's id is its least id that isn't null); ties go to the least. Extra columns are
ignored. An empty table gives no rows. A very long text is read whole; its counts take a tenth of its size. Tokens are
compared by their 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm._shared import Scratch, free_name, grams, hashes, lean, mixed, spaced_words, table
from candlewick.llm.components import components

GROUP = 64
#: Nodes (their ids, digests and groups: about 150 bytes each in Spark's hashed form) that may be broadcast to fetch their
#: texts; beyond, the texts are joined by shuffle.
MOST_BROADCAST = 250_000
#: A level's largest size over its smallest.
LEVEL = 1.6
SEEDS = 3
#: Nodes of a signature beyond which sets that can do without it do.
MANY = 8
#: Nodes of a group in pass 4, where larger groups meet less often.
REGROUP = 256
#: Nodes that ask a group at once.
ASKING = 512
#: Signatures that a task packs at once.
SIGNED = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Measure:
    """Words per token, and the threshold as num / den."""

    def __init__(self, n: int, num: int, den: int, split=spaced_words):
        self.n, self.num, self.den, self.split = n, num, den, split

    def tokens(self, text: str | None) -> np.ndarray:
        """Ordered distinct hashes of the word n-grams; of fewer words the hash of all."""
        h = hashes(self.split(text))
        if not len(h):
            return h
        # a run of fewer words is no n-gram of another text
        return np.unique(grams(h, self.n) if len(h) >= self.n else mixed(grams(h, len(h)) + np.uint64(len(h))))

    def links(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)


@cache
def level(k: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Smallest and largest size of the k-th level, differences that a link may have there, ranges."""
    low = -(-num // (den - num)) if k == 0 else level(k - 1, num, den)[1] + 1
    high = max(low, int(low * LEVEL))
    differ = high * (den - num) // num
    ranges = differ + 1
    while ranges * (1 - math.exp(-low / ranges)) < 1.05 * differ + 1 and ranges < 2 * differ + 2:
        ranges += 1
    return low, high, differ, ranges


@cache
def _edges(ranges: int) -> np.ndarray:
    return np.array([i * 2**64 // ranges for i in range(1, ranges)], np.uint64)


def signatures(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures, of which sets that differ and link share at least one; and for each its level and seed (low
    byte) and how many signatures of that level the set can do without (high byte)."""
    size, out, marks, k = len(tokens), [tokens[:0]], [np.zeros(0, np.uint16)], 0
    if size < level(0, num, den)[0]:
        return out[0], marks[0]
    while level(k, num, den)[1] < size:
        k += 1
    while k >= 0 and level(k, num, den)[1] * den >= num * size:
        _, _, differ, ranges = level(k, num, den)
        for seed in range(SEEDS):
            ordered = tokens if not seed else np.sort(mixed(tokens + np.uint64(seed * int(_STEP) % 2**64)))
            at = np.concatenate([[0], np.searchsorted(ordered, _edges(ranges)), [size]])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ordered ^ _STEP), dtype=np.uint64)])
            named = mixed(np.arange(ranges, dtype=np.uint64) + np.uint64(k * SEEDS + seed << 32))
            signs, full = mixed((sums[at[1:]] - sums[at[:-1]]) ^ named), at[1:] > at[:-1]
            spare = int(full.sum()) - differ - 1
            out.append(signs if seed == SEEDS - 1 and spare < 0 else signs[full])
            # a set that signs under several seeds needs all of its signatures
            marks.append(np.full(len(out[-1]), k * SEEDS + seed | (0 if seed else min(max(spare, 0), 255)) << 8, np.uint16))
            if spare >= 0:
                break
        k -= 1
    return np.concatenate(out), np.concatenate(marks)


def _digest(tokens: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes())


def _short(node: bytes) -> int:
    """A node's name while signatures are compared; should two nodes have the same, both stand for it from then on."""
    return int.from_bytes(node[:8], "little", signed=True)


def counted(tokens: np.ndarray) -> np.ndarray:
    """Tokens by equal ranges of token space, somewhat fewer ranges than tokens, up to 255 in each."""
    bits = max(5, (len(tokens) - 1).bit_length() - 1)
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Rows of counts by fewer ranges."""
    if counts.shape[1] == width:
        return counts
    return np.minimum(counts.reshape(len(counts), width, -1).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


def reaching(measure: Measure, a: list[np.ndarray], sizes_a: np.ndarray, b: list[np.ndarray], sizes_b: np.ndarray) -> np.ndarray:
    """Which sets of a may link with which of b, by their counts and sizes: never misses a link."""
    out = measure.links(np.minimum(sizes_a[:, None], sizes_b[None, :]), sizes_a[:, None], sizes_b[None, :])
    widths_a, widths_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for wa in np.unique(widths_a):
        for wb in np.unique(widths_b):
            at, to = np.flatnonzero(widths_a == wa), np.flatnonzero(widths_b == wb)
            if not out[np.ix_(at, to)].any():
                continue
            x, y = (_folded(np.stack([sets[i] for i in some]), min(wa, wb)) for sets, some in ((a, at), (b, to)))
            for i, row in zip(at, x):
                some = to[out[i, to]]
                if len(some):
                    # a full range may hold any number
                    near = np.minimum(row, y[out[i, to]])
                    inter = near.sum(axis=1, dtype=np.int64) if near.max() < 255 else np.where(near.max(axis=1) < 255, near.sum(axis=1, dtype=np.int64), sizes_b[some])
                    out[i, some] = measure.links(np.minimum(inter, sizes_b[some]), sizes_a[i], sizes_b[some])
    return out


NAMED = "doc_id long, n_shingles long, node binary, h long, counts binary"


def _named(measure: Measure):
    """Pass 1: id, set size, node and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [measure.tokens(x.as_py()) for x in batch.column(1)]
            nodes = [_digest(x) if len(x) else None for x in sets]
            counts = [counted(x).tobytes() if len(x) else None for x in sets]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([x and _short(x) for x in nodes], pa.int64()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "h", "counts"])

    return run


def _signed(measure: Measure, reducers: int):
    """Pass 2, before the shuffle: signatures and short node names, packed by reducer. A set signs once in a task."""

    def packed(signs: list[np.ndarray], marks: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        flat, mark = np.concatenate(signs), np.concatenate(marks)
        of = np.repeat(np.array(names, np.int64), [len(x) for x in signs])
        to = flat % np.uint64(reducers)
        order = np.argsort(to, kind="stable")
        flat, mark, of, to = flat[order], mark[order], of[order], to[order]
        cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        spans = list(zip(cuts, cuts[1:]))
        columns = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (flat, mark, of)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int64)), *columns], names=["reducer", "signs", "marks", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        signs, marks, names, size = [], [], [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = measure.tokens(text.as_py())
                name = _short(_digest(tokens))
                if name in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(name)
                found, mark = signatures(tokens, measure.num, measure.den)
                if len(found):
                    signs.append(found)
                    marks.append(mark)
                    names.append(name)
                    size += len(found)
                if size > SIGNED:
                    yield packed(signs, marks, names)
                    signs, marks, names, size = [], [], [], 0
        if size:
            yield packed(signs, marks, names)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Pass 2, after the shuffle: signatures of several nodes, with each node, the least of them, and whether they are many."""
    signs, marks, names = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("signs", np.uint64), ("marks", np.uint16), ("names", np.int64)))
    order = np.lexsort((names, signs))
    signs, marks, names = signs[order], marks[order], names[order]
    new = np.concatenate([[True], (signs[1:] != signs[:-1]) | (names[1:] != names[:-1])])
    signs, marks, names = signs[new], marks[new], names[new]
    first = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
    counts = np.diff(np.concatenate([first, [len(signs)]]))
    kept = np.repeat(counts > 1, counts)
    least, many = np.repeat(names[first], counts), np.repeat(counts > MANY, counts)
    return pa.table(
        {
            "sig": signs[kept].astype(np.int64), "h": names[kept], "lead": least[kept], "level": (marks[kept] & 255).astype(np.int32),
            "spare": (marks[kept] >> 8).astype(np.int32), "many": many[kept],
        }
    )


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of rows with each of columns, by a product of 0-1 matrices in blocks of tokens."""
    known = np.unique(np.concatenate(columns))
    out = np.zeros((len(rows), len(columns)))

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        places = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[places] == flat
        return places[hit], of[hit]

    (rp, ro), (cp, co) = placed(rows), placed(columns)
    r_order, c_order = np.argsort(rp, kind="stable"), np.argsort(cp, kind="stable")
    rp, ro, cp, co = rp[r_order], ro[r_order], cp[c_order], co[c_order]
    for start in range(0, len(known), 8192):
        ra, rb = np.searchsorted(rp, [start, start + 8192])
        ca, cb = np.searchsorted(cp, [start, start + 8192])
        if rb > ra and cb > ca:
            x, y = np.zeros((len(rows), 8192), np.float32), np.zeros((len(columns), 8192), np.float32)
            x[ro[ra:rb], rp[ra:rb] - start] = 1
            y[co[ca:cb], cp[ca:cb] - start] = 1
            out += x @ y.T
    return out


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compared(measure: Measure):
    """Joins the nodes of an opened group that link, each to the least node of its component."""

    def run(rows: pa.Table) -> pa.Table:
        members = dict(zip(rows.column("node").to_pylist(), _sets(rows.column("tokens"))))
        nodes = sorted(members)
        sets = [members[x] for x in nodes]
        sizes = np.array([len(x) for x in sets])
        linked = measure.links(_overlaps(sets, sets), sizes[:, None], sizes[None, :])
        root = list(range(len(nodes)))
        for i in range(len(nodes)):
            if root[i] == i:
                reached, todo = {i}, [i]
                while todo:
                    new = [int(j) for j in np.flatnonzero(linked[todo.pop()]) if int(j) not in reached]
                    reached.update(new)
                    todo += new
                for j in reached:
                    root[j] = i
        found = [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], schema=LINKS)

    return run


MATRIX = "g long, nodes array<binary>, roots array<binary>, sizes array<long>, counts array<binary>, widths array<int>, unions array<binary>"


def _row(key: tuple, rows: pa.Table) -> pa.Table:
    """A group's row of the matrix: its nodes and their counts, and for each number of ranges that these have the union's."""
    counts = [np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()]
    unions: dict[int, np.ndarray] = {}
    for x in counts:
        unions[len(x)] = np.maximum(unions[len(x)], x) if len(x) in unions else x
    values = [key[0].as_py(), *(rows.column(c).to_pylist() for c in ("node", "root", "n", "counts")), list(unions), [x.tobytes() for x in unions.values()]]
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=["g", "nodes", "roots", "sizes", "counts", "widths", "unions"])


def _own(measure: Measure):
    """Pass 3: the nodes of a group that may link with another node of it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, sizes = rows.column("node").to_pylist(), rows.column("n").to_numpy()
        counts = [np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()]
        near = [nodes[i] for i in np.flatnonzero(reaching(measure, counts, sizes, counts, sizes).sum(axis=1) > 1)]
        return pa.table([pa.array([key[0].as_py()] * len(near), pa.int64()), pa.array(near, pa.binary())], names=["g", "node"])

    return run


def _asked(measure: Measure):
    """Pass 4: bounds the overlap of nodes with a group's union, then with its nodes, and gives those of either that may link."""

    def run(key: tuple, queries: pa.Table, group: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        if queries.num_rows and group.num_rows:
            row = group.to_pylist()[0]
            nodes, roots, sizes, counts = row["nodes"], row["roots"], np.array(row["sizes"]), [np.frombuffer(x, np.uint8) for x in row["counts"]]
            asking, own, n = queries.column("node").to_pylist(), queries.column("root").to_pylist(), queries.column("n").to_numpy()
            sets = [np.frombuffer(x, np.uint8) for x in queries.column("counts").to_pylist()]
            unions = [np.frombuffer(x, np.uint8) for x in row["unions"]]
            # a linked node is under the union of its own width; of the sizes there the one nearest to the overlap asks least
            reached = np.zeros(len(sets), bool)
            for union, width in zip(unions, row["widths"]):
                under = sizes[[len(c) == width for c in counts]]
                for w in {len(x) for x in sets}:
                    at = np.flatnonzero([len(x) == w for x in sets])
                    small = min(w, width)
                    near = np.minimum(_folded(np.stack([sets[i] for i in at]), small), _folded(union[None, :], small))
                    inter = np.where(near.max(axis=1) < 255, np.minimum(near.sum(axis=1, dtype=np.int64), n[at]), n[at])
                    least = np.clip(inter, under.min(), under.max())
                    reached[at] |= measure.links(np.minimum(inter, least), n[at], least)
            some = np.flatnonzero(reached)
            if len(some):
                near = reaching(measure, [sets[i] for i in some], n[some], counts, sizes)
                for i, j in zip(*np.nonzero(near)):
                    if own[some[i]] != roots[j]:
                        found |= {asking[some[i]], nodes[j]}
        out = sorted(found)
        at = [k.as_py() for k in key]
        return pa.table([pa.array([at[0]] * len(out), pa.int64()), pa.array([at[1]] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["to", "block", "node"])

    return run


def _tokens_of(measure: Measure):
    """Of text, node and groups: a row with the node's tokens for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, node, groups in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = measure.tokens(text.as_py())
                if len(tokens) and _digest(tokens) == node:
                    out += [(g, node, tokens.tobytes()) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["g", "node", "tokens"])

    return run


def _opened(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) in opened groups. wanted: g, node and rep, the id of a document of the node."""
    fetched = wanted.groupBy("node", "rep").agg(F.collect_set("g").alias("groups"))
    if wanted.count() <= MOST_BROADCAST:
        fetched = F.broadcast(fetched)
    texts = docs.join(fetched, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node", "groups")
    sets = texts.mapInArrow(lean(_tokens_of(measure)), "g long, node binary, tokens binary")
    return sets.groupBy("g").applyInArrow(_compared(measure), "a binary, b binary")


def _spread(column: str, groups: str) -> str:
    return f"pmod(xxhash64({column}), {groups})"


def classes(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = scratch.keep(docs.mapInArrow(lean(_named(measure)), NAMED), "named")
    reps = named.where("node IS NOT NULL").groupBy("node", "h").agg(F.min("doc_id").alias("rep"))

    reducers = 4 * docs.rdd.getNumPartitions()
    signed = docs.select("text").mapInArrow(lean(_signed(measure, reducers)), "reducer long, signs binary, marks binary, names binary")
    found = scratch.keep(signed.groupBy("reducer").applyInArrow(_shared, "sig long, h long, lead long, level int, spare int, many boolean"), "found")
    # a set does without its signatures of many nodes if enough others are left to share one with any set that it links to
    many = found.where("many")
    needed = many.groupBy("h", "level").agg(F.count("*").alias("n"), F.max("spare").alias("s")).where("n > s").select("h", "level")
    shared = scratch.keep(found.where("NOT many").unionByName(many.join(needed, ["h", "level"]).select(*found.columns)).select("sig", "h", "lead"), "shared")
    scratch.drop("found")

    # groups: nodes with the same lead, split by hash into about GROUP; in two ways where there are several
    leads = shared.groupBy("h").agg(F.min("lead").alias("lead"))
    sizes = leads.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = leads.join(sizes, "lead").select(
        "h",
        "lead",
        F.expr(f"xxhash64(lead, {_spread('h', 'parts')})").alias("g1"),
        F.expr(f"IF(parts > 1, xxhash64(lead, {_spread('h, 1', 'parts')}, 1), NULL)").alias("g2"),
    )
    members = scratch.keep(reps.join(dealt, "h").select("node", "h", "rep", "lead", "g1", "g2"), "members")
    counted_ = named.select(F.col("doc_id").alias("rep"), F.col("node").alias("of"), F.col("n_shingles").alias("n"), "counts")
    same = members["rep"].eqNullSafe(counted_["rep"]) & (F.col("node") == F.col("of"))
    # a node's counts once, whichever of its rows they come from
    counts = scratch.keep(members.join(counted_, same).select("node", members["rep"], "g1", "g2", "n", "counts").dropDuplicates(["node"]), "counts")

    grouped = counts.select(F.explode(F.expr("filter(array(g1, g2), x -> x IS NOT NULL)")).alias("g"), "node", "n", "counts")
    near = scratch.keep(grouped.groupBy("g").applyInArrow(_own(measure), "g long, node binary"), "near")
    within = components(_opened(docs, near.join(members.select("node", "rep"), "node"), measure), scratch, "within")

    # groups anew: large components by themselves, small ones whole, so that a group spans few components
    labelled = members.join(within, "node", "left").select("node", "h", "lead", F.coalesce("root", "node").alias("root"))
    per = labelled.groupBy("lead", "root").agg(F.count("*").alias("n"))
    small = per.where(f"n < {REGROUP}").groupBy("lead").agg(F.ceil(F.sum("n") / REGROUP).alias("parts"))
    placed = per.join(small, "lead", "left").selectExpr("lead", "root", f"IF(n < {REGROUP}, NULL, ceil(n / {REGROUP})) AS own", "coalesce(parts, 1) AS parts")
    group = f"IF(own IS NULL, xxhash64(lead, {_spread('root', 'parts')}), xxhash64(lead, root, {_spread('h', 'own')}))"
    regrouped = scratch.keep(labelled.join(placed, ["lead", "root"]).select("node", "h", "root", F.expr(group).alias("g")), "regrouped")

    # signatures that span components, and which groups each of them has
    placed = shared.select("sig", "h").join(regrouped.select("h", "node", "root", "g"), "h")
    several = placed.groupBy("sig").agg(F.min("root").alias("l"), F.max("root").alias("u")).where("l <> u").select("sig")
    spans = scratch.keep(placed.join(several, "sig").select("sig", "g", "node", "root"), "spans")
    of_group = regrouped.groupBy("g").agg(F.count("*").alias("m"))
    per_sig = spans.groupBy("sig", "g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).join(of_group, "g")
    asking = spans.join(of_group, "g").select("sig", "node", "root", "m", F.col("g").alias("own"))
    to = per_sig.select("sig", F.col("g").alias("to"), "lo", "hi", F.col("m").alias("size"))
    # the smaller of two groups asks the larger, about which a node only asks if it has other components
    meets = "(m < size OR m = size AND own <= to) AND (root <> lo OR root <> hi)"
    asked = scratch.keep(asking.join(to, "sig").where(meets).select("node", "root", "to").distinct(), "asked")
    scratch.drop("shared", "spans")
    if asked.isEmpty():
        roots = within
    else:
        matrix = regrouped.select("node", "root", "g").join(counts.select("node", "n", "counts"), "node").groupBy("g").applyInArrow(_row, MATRIX)
        blocks = asked.groupBy("to").agg(F.ceil(F.count("*") / ASKING).alias("blocks"))
        queries = asked.join(blocks, "to").withColumn("block", F.expr(_spread("node", "blocks"))).join(counts.select("node", "n", "counts"), "node").select("to", "block", "node", "root", "n", "counts")
        # under names of its own, as both sides come from the same tables
        opened = matrix.join(blocks.select(F.col("to").alias("g"), "blocks"), "g").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        reached = queries.groupBy("to", "block").cogroup(opened.groupBy("g", "b")).applyInArrow(_asked(measure), "to long, block long, node binary")
        reached = scratch.keep(reached.select(F.xxhash64("to", "block").alias("g"), "node"), "reached")
        across = _opened(docs, reached.join(members.select("node", "rep"), "node"), measure)
        roots = components(within.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across), scratch, "across")

    of = members.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = scratch.keep(of.join(least, "root").select("node", "component_id"), "joined")
    scratch.drop("members", "counts", "near", "regrouped", "asked", "reached")
    final = reps.join(joined, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return named.join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_token_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Measure(3, 90, 100))


def one_of_each(docs: DataFrame, measure: Measure) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: that of the least doc_id.

    Where ids repeat or are null, rows are numbered, and the first row of a class stays.
    """
    key = free_name(docs.columns, "class_key")
    unique = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    if unique:
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        keyed = Scratch(docs.sparkSession, "jaccard-rows").keep(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    found = classes(keyed.select(F.col(key).alias("doc_id"), "text"), measure)
    gone = Scratch(docs.sparkSession, "jaccard-gone").keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
