r"""URL filters over a sorted digest array.

Rules (host, path prefix, verdict) are compiled into one file: the sorted 64-bit xxhash keys of host + path, and for
each its verdict and full string. The file is written once to the shared folder, Spark hands it to the executors, and
each worker memory-maps it, so workers of one machine share its pages. For a batch of URLs every host suffix with every
path prefix, both of lengths that occur among the rules, is hashed; one vectorised binary search probes all of them, and a
hit counts only if the stored string is equal, so collisions change nothing. The longest rule wins.

A list of more than most_rules rules is cut by its keys into several files of at most so many, and each URL is held
against one after the other, so what a machine maps at once stays bounded and the result is the same.

Defined results: a null URL or one without :// has an empty host and path and fits no rule; repeated rows are judged
one by one; ties in length go to the longer host; of a rule that comes twice the last counts; rules need a host. A very
long URL has no more candidates than the rules have lengths. Other columns stay (those named host, path, rule,
rule_verdict are replaced). An empty table or an empty list are fine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm._shared import scratch_root, table

#: About 100 bytes each: 200 MB on a machine.
MOST_RULES = 2_000_000
#: The rules that come first.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Hosts that the method blocks, with their subdomains, where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{zone}" for name in ("spam-farm", "casino-win", "ads-track", "cheap-pills", "free-bets", "adult-x") for zone in ("com", "net", "org"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: min((k for k in map(path.find, "?#") if k >= 0), default=len(path))]


def candidates(host: str, path: str, lengths: Iterable[tuple[int, int]]) -> list[str]:
    """Rules that could fit, the longest first, of these the longer host; lengths: those of rules' hosts and paths, in that order."""
    n, m = len(host), len(path)
    return [host[n - h :] + path[:p] for h, p in lengths if p <= m and (h == n or h < n and host[n - h - 1] == ".")]


def compiled(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: count, pairs of host and path length, the longest first, sorted keys, then by key the verdict and the end of its string, then the strings."""
    from xxhash import xxh3_64_intdigest

    by_text = {h.translate(_LOWER) + p: v for h, p, v in rules if h}
    lengths = sorted({(len(h), len(p)) for h, p, _ in rules if h}, key=lambda x: (-sum(x), -x[0]))
    order = sorted((xxh3_64_intdigest(text.encode()), text) for text in by_text)
    strings = [text.encode() for _, text in order]
    head = np.array([len(order), 2 * len(lengths), *(n for x in lengths for n in x)], np.uint64)
    verdicts = np.array([by_text[text] == "block" for _, text in order], np.uint64)
    return b"".join(x.tobytes() for x in (head, np.array([k for k, _ in order], np.uint64), verdicts, np.cumsum([0, *map(len, strings)]).astype(np.uint64))) + b"".join(strings)


class Digests:
    """A memory-mapped file of rules."""

    def __init__(self, path: str):
        words = np.memmap(path, np.uint64, "r", shape=(2,))
        n, k = int(words[0]), int(words[1])
        numbers = np.memmap(path, np.uint64, "r", shape=(3 + k + 3 * n,))
        self.lengths = [(int(numbers[i]), int(numbers[i + 1])) for i in range(2, 2 + k, 2)]
        self.keys, self.blocks, self.ends = numbers[2 + k : 2 + k + n], numbers[2 + k + n : 2 + k + 2 * n], numbers[2 + k + 2 * n :]
        self.strings = np.memmap(path, np.uint8, "r", offset=numbers.nbytes) if n else np.zeros(0, np.uint8)

    def longest(self, texts: list[list[str]]) -> list[tuple[str, str] | None]:
        """For each list of candidates the first that is a rule, with its verdict."""
        from xxhash import xxh3_64_intdigest

        flat = np.array([xxh3_64_intdigest(x.encode()) for xs in texts for x in xs], np.uint64)
        places = np.searchsorted(self.keys, flat)
        hit = places < len(self.keys)
        hit[hit] = self.keys[places[hit]] == flat[hit]
        out, at = [], 0
        for xs in texts:
            found = None
            for j in np.flatnonzero(hit[at : at + len(xs)]):
                i = int(places[at + j])
                while found is None and i < len(self.keys) and self.keys[i] == flat[at + j]:
                    if bytes(self.strings[int(self.ends[i]) : int(self.ends[i + 1])]) == xs[j].encode():
                        found = (xs[j], "block" if self.blocks[i] else "allow")
                    i += 1
                if found:
                    break
            at += len(xs)
            out.append(found)
        return out


def _hand_out(spark: SparkSession, data: bytes) -> str:
    """Writes to the shared folder, has Spark copy the file to the executors, and returns its name there."""
    from xxhash import xxh3_128_hexdigest

    name = f"url-rules-{xxh3_128_hexdigest(data)}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def _files(rules: list[tuple[str, str, str]], most: int) -> list[list[tuple[str, str, str]]]:
    """The rules by equal ranges of their keys, a rule that comes twice in one part."""
    from xxhash import xxh3_64_intdigest

    parts_ = max(1, -(-len(rules) // most))
    out: list[list] = [[] for _ in range(parts_)]
    for h, p, v in rules:
        out[xxh3_64_intdigest((h.translate(_LOWER) + p).encode()) * parts_ >> 64].append((h, p, v))
    return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", most_rules: int = MOST_RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict (null where no rule fits) to pages."""
    pages = pages.drop("host", "path", "rule", "rule_verdict")
    names = [*pages.columns, "host", "path", "rule", "rule_verdict"]
    schema = T.StructType([*pages.schema.fields, *(T.StructField(x, T.StringType()) for x in names[-4:])])
    at, out = pages.columns.index(url), pages

    def searched(name: str, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digests = Digests(SparkFiles.get(name))
            for batch in batches:
                split = [parts(x) for x in batch.column(at).to_pylist()]
                found = digests.longest([candidates(h, p, digests.lengths) for h, p in split])
                if not first:
                    before = zip(batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist())
                    found = [_longer(f, b, h) for f, b, (h, _) in zip(found, before, split)]
                columns = [[h for h, _ in split], [p for _, p in split], [f and f[0] for f in found], [f and f[1] for f in found]]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 4], *(pa.array(c, pa.string()) for c in columns)], names=names)

        return run

    for k, part in enumerate(_files(list(rules), most_rules)):
        out = out.mapInArrow(searched(_hand_out(pages.sparkSession, compiled(part)), not k), schema)
    return out


def _longer(found: tuple[str, str] | None, before: tuple[str | None, str | None], host: str) -> tuple[str, str] | None:
    """Of the rules that two files give the longer, in a tie that with the longer host, which is the part that ends the host."""
    if found is None or before[0] is None:
        return found or (before if before[0] is not None else None)
    rank = lambda rule: (len(rule), next(n for n in range(min(len(rule), len(host)), 0, -1) if rule[:n] == host[len(host) - n :]))
    return max(found, before, key=lambda x: rank(x[0]))


def op3_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, RULES)
    # the method's own list is asked only where no rule fits
    judged = judge(judged.withColumnsRenamed({"host": "h", "path": "p", "rule": "r", "rule_verdict": "v"}), [(h, "", "block") for h in BLOCKED_HOSTS])
    return judged.select("page_id", F.col("h").alias("host"), F.col("p").alias("path"), F.col("r").alias("rule"), F.coalesce("v", "rule_verdict", F.lit("allow")).alias("verdict"))


_HOSTS = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
_LIST = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT * FROM (VALUES {_LIST}) AS t(h, p, v)),
f AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM s JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{_HOSTS}]) AS b) WHERE host = b OR ends_with(host, '.' || b)) THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (k)
"""
