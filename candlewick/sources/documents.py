"""Files into lines. A reader turns a file's bytes into (page, line_no, line, is_heading or null) and is found by extension."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.errors import EmptyDocumentError, UnreadableFileError, UnsupportedFileTypeError
from candlewick.functions.text import basename, looks_like_heading
from candlewick.operators.segment import segment
from candlewick.sources import pdf
from candlewick.storage import Scratch, exists, hadoop_path

log = logging.getLogger(__name__)

Line = tuple[int | None, int, str, bool | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> Iterator[Line]:
    """Body paragraphs that aren't blank; those whose style's name has heading or title in it are headings."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        package.getinfo("word/document.xml")
    except (zipfile.BadZipFile, KeyError) as e:
        raise UnreadableFileError(f"{type(e).__name__}: {e}") from e
    with package as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    marks = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
    for k, p in enumerate(body.findall(f"{_W}p") if body is not None else ()):
        text = "".join((x.text or "") if marks[x.tag] is None else marks[x.tag] for x in p.iter() if x.tag in marks).strip()
        if text:
            style = p.find(f"{_W}pPr/{_W}pStyle")
            of = style.get(f"{_W}val", "") if style is not None else ""
            name = names.get(of, of).lower()
            yield None, k, text, "heading" in name or "title" in name


def pdf_lines(content: bytes) -> Iterator[Line]:
    for page, text in enumerate(pdf.pages(content), 1):
        for k, line in enumerate(text.split("\n")):
            yield page, k, line, None


READERS: dict[str, Callable[[bytes], Iterable[Line]]] = {".docx": docx_lines, ".pdf": pdf_lines}


#: Paths (about 200 bytes each) that may be broadcast to give files their places in the list; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    at = name.rfind(".")
    return name[at:].lower() if at > 0 and name[:at].strip(".") else ""


def routed(spark: SparkSession, paths: list[str], readers: dict = READERS) -> list[str]:
    """The extensions of the files; raises for one that isn't there, then for one that no reader is for."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)
        if _extension(path) not in readers:
            raise UnsupportedFileTypeError(f"{path}: supported are {', '.join(sorted(readers))}")
    return [_extension(p) for p in paths]


def _qualified(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths as Spark's binary reader names them."""
    _, fs = hadoop_path(spark, ".")
    root, here = re.sub(r"(?<=:)/+$", "", fs.getUri().toString()).rstrip("/"), fs.getWorkingDirectory().toUri().getPath()
    out = []
    for path in paths:
        scheme, host, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(.*)", path, re.S).groups() if "://" in path or re.match(r"\w+:/", path) else (None, None, path)
        rest = re.sub("/+", "/", rest if rest.startswith("/") else f"{here}/{rest}")
        own = root if scheme is None or (scheme == root.split(":")[0] and host in (None, "//")) else f"{scheme}:{host if host != '//' else ''}"
        out.append(own + (rest.rstrip("/") or "/"))
    return out


def read_lines(spark: SparkSession, paths: list[str], readers: dict = READERS) -> DataFrame:
    """file_pos, file, source_file, page, line_no, line, is_heading and error of the files, each read by one task.

    error is that of a file that can't be opened; a fault inside one that can is raised.
    """
    at = _qualified(spark, paths)
    if any(_extension(p) not in readers for p in paths):
        routed(spark, paths, readers)
    try:  # Spark looks for all files at once
        read = spark.read.format("binaryFile").load(sorted(set(at))).select("path", "content")
    except AnalysisException:
        routed(spark, paths, readers)
        raise
    known = {ext: readers[ext] for ext in {_extension(p) for p in paths}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, error = [], None
                try:
                    rows = list(known[_extension(path)](content.as_py()))
                    if not rows:
                        error = "no text"
                except UnreadableFileError as e:
                    error = str(e)
                rows = rows or [(None, None, None, None)]
                columns = [[path] * len(rows), *([r[k] for r in rows] for k in range(4)), [error] * len(rows)]
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["at", "page", "line_no", "line", "styled", "error"])

    # a file that the list has twice keeps both its places
    places = spark.createDataFrame([(x, pos, path) for pos, (x, path) in enumerate(zip(at, paths))], "at string, file_pos int, file string")
    if len(paths) <= MOST_BROADCAST:
        places = F.broadcast(places)
    made = read.mapInArrow(run, "at string, page int, line_no int, line string, styled boolean, error string").join(places, "at").drop("at")
    return made.withColumns({"source_file": basename(F.col("file")), "is_heading": F.coalesce("styled", looks_like_heading(F.col("line")))}).drop("styled")


def blocks_of(lines: DataFrame) -> DataFrame:
    """file_pos, block_pos, source_file, page_number, heading and text of what read_lines() gives."""
    keyed = lines.where("error IS NULL").withColumn("file", F.struct("file_pos", "source_file"))
    made = segment(keyed)
    return made.select("file.file_pos", "block_pos", "file.source_file", F.col("page").alias("page_number"), "heading", "text")


def extract(spark: SparkSession, path: str) -> DataFrame:
    """The text blocks of one file; raises if it has none."""
    blocks = Scratch(spark, "blocks").keep(blocks_of(read_lines(spark, [path])), "blocks")
    if blocks.isEmpty():
        raise EmptyDocumentError(f"no text in {path}")
    return blocks


def ingest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The text blocks of the files, in order. Files without text are skipped with a warning; missing and unknown ones raise."""
    if not paths:
        raise EmptyDocumentError("no files are given")
    blocks = Scratch(spark, "blocks").keep(blocks_of(read_lines(spark, paths)), "blocks")
    found = {r.file_pos for r in blocks.select("file_pos").distinct().collect()}
    for pos, path in enumerate(paths):
        if pos not in found:
            log.warning("skipping %s: no text", path)
    return blocks
