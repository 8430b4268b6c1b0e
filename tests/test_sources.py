import re
import zipfile
import zlib

import pytest

from candlewick import errors
from candlewick.config import Settings
from candlewick.functions.vectors import KeywordEmbedder
from candlewick.operators.chunk import Chunker
from candlewick.operators.retrieve import VectorIndex
from candlewick.pipeline import RetrievalPipeline
from candlewick.sources import documents as d
from candlewick.sources import pdf
from candlewick.streaming.ingest import BLOCKS, follow

EMBEDDER = KeywordEmbedder((("force", "mass"), ("heat", "entropy"), ("cell", "organism")))


def write_docx(path, paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:styleId="S{k}"><w:name w:val="{n}"/></w:style>' for k, n in enumerate(["heading 1", "Normal", "Subtitle"]))
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="S{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}{table}</w:body></w:document>")
    return str(path)


def write_pdf(path, pages):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] >>"]
    out = [x.encode() for x in objects]
    for k, lines in enumerate(pages):
        shown = "BT /F1 12 Tf 72 720 Td " + " 0 -14 Td ".join(f"({x}) Tj" for x in lines) + " ET"
        data = zlib.compress(shown.encode())
        out.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode())
        out.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
    path.write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in enumerate(out, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF")
    return str(path)


@pytest.fixture
def docx(tmp_path):
    return write_docx(tmp_path / "Book.DOCX", [(0, "Mechanics"), (1, "Force moves mass."), (1, "  "), (1, "Mass resists."), (2, "Heat"), (1, "Entropy is heat. It grows.")])


@pytest.fixture
def book(tmp_path):
    return write_pdf(tmp_path / "book.pdf", [["CHAPTER 1 THE CELL", "A cell is an organism \\(small\\).", "It lives."], ["More of it.", "CHAPTER 2 THE END"]])


def rows(df):
    return [(r.block_pos, r.source_file, r.page_number, r.heading, r.text) for r in df.orderBy("file_pos", "block_pos").collect()]


def test_docx(spark, docx):
    assert rows(d.extract(spark, docx)) == [(0, "Book.DOCX", None, "Mechanics", "Force moves mass.\nMass resists."), (1, "Book.DOCX", None, "Heat", "Entropy is heat. It grows.")]


def test_pdf(spark, book):
    assert rows(d.extract(spark, book)) == [(0, "book.pdf", 1, "CHAPTER 1 THE CELL", "A cell is an organism (small).\nIt lives."), (1, "book.pdf", 2, "CHAPTER 1 THE CELL", "More of it.")]


def test_pdf_strings():
    assert pdf._string(rb"(a\(b\)\051\n)") == "a(b))\n" and pdf._string(b"<4142 4>") == "AB@"
    assert pdf._shown(b"BT [(a) -300 (b) 20 (c)] TJ T* (d) Tj ET") == "a bc\nd"


TABLE = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0BA4> <00660069>] endbfrange"


def _file(objects, key=None):
    """A PDF of numbered objects; those given as (head, stream) are deflated, and encrypted if there is a key."""
    out = b"%PDF-1.4\n"
    for n, x in objects.items():
        if isinstance(x, tuple):
            raw = zlib.compress(x[1])
            raw = pdf._rc4(pdf.object_key(key, n, 0), raw) if key else raw
            x = b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(raw), x[0], raw)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    return out


def _composite(key=None, more=b""):
    page = b"BT /F1 12 Tf <001000110012> Tj <00030020> Tj /F2 9 Tf T* (plain) Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Resources 6 0 R >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: (b"", page),
        5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", 6: b"<< /Font << /F1 5 0 R /F2 8 0 R >> >>", 7: (b"", TABLE), 8: b"<< /Type /Font /Subtype /Type1 >>",
    }
    return _file(objects, key) + more


def test_pdf_composite_fonts():
    assert list(pdf.pages(_composite())) == ["ABC \u0ba4\nplain"]
    assert pdf.Codes(TABLE).text(b"\x00\x21\x00\x99\x00\x10") == "fiA"


def test_pdf_encrypted_without_a_password():
    # the example of RC4's description
    assert pdf._rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    owner, first = bytes(range(32)), b"0123456789abcdef"
    for version, revision, length in ((1, 2, 40), (2, 3, 128)):
        key = pdf.file_key(owner, -44, first, revision, length // 8)
        more = b"9 0 obj\n<< /Filter /Standard /V %d /R %d /Length %d /P -44 /O <%s> /U <00> >>\nendobj\ntrailer << /Encrypt 9 0 R /ID [<%s> <%s>] >>" % (version, revision, length, owner.hex().encode(), first.hex().encode(), first.hex().encode())
        assert list(pdf.pages(_composite(key, more))) == ["ABC \u0ba4\nplain"]
    with pytest.raises(pdf.PdfError, match="pypdf"):
        list(pdf.pages(_composite(None, b"9 0 obj\n<< /Filter /Standard /V 4 /O (x) >>\nendobj\ntrailer << /Encrypt 9 0 R >>")))


def test_files_that_cannot_be_opened_are_skipped_and_faults_inside_raised(spark, tmp_path, book):
    broken = _composite().replace(b"/Length", b"/Lengtg")
    (tmp_path / "cut.pdf").write_bytes(re.sub(rb"(4 0 obj.*?stream\n)..", rb"\1!!", broken, count=1, flags=re.S))
    with pytest.raises(Exception, match="zlib|incorrect header|error"):
        d.ingest(spark, [book, str(tmp_path / "cut.pdf")]).collect()
    (tmp_path / "none.pdf").write_bytes(b"%PDF-1.4 nothing")
    assert d.ingest(spark, [book, str(tmp_path / "none.pdf")]).select("source_file").distinct().count() == 1


def test_faults(spark, tmp_path, docx):
    with pytest.raises(FileNotFoundError):
        d.extract(spark, str(tmp_path / "none.docx"))
    with pytest.raises(FileNotFoundError):
        d.routed(spark, [str(tmp_path / "none.txt")])
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(errors.UnsupportedFileTypeError, match=".docx, .pdf"):
        d.routed(spark, [str(tmp_path / "x.txt")])
    for name, content in (("bad.docx", b"no zip"), ("bad.pdf", b"%PDF-1.4\n%")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(errors.EmptyDocumentError):
            d.extract(spark, str(tmp_path / name))
    assert d.routed(spark, [docx]) == [".docx"]


def test_own_reader(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\nbody")
    readers = d.READERS | {".md": lambda c: [(None, k, x.lstrip("# "), x.startswith("#")) for k, x in enumerate(c.decode().split("\n"))]}
    assert rows(d.blocks_of(d.read_lines(spark, [str(tmp_path / "a.md")], readers))) == [(0, "a.md", None, "Title", "body")]


@pytest.fixture
def pipeline(spark):
    return RetrievalPipeline(spark, Settings(min_chunk_chars=10, max_chunk_chars=500, breakpoint_percentile=60.0, default_top_k=3), EMBEDDER)


def test_files_to_answers(spark, pipeline, docx, book, tmp_path, caplog):
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\n%")
    with caplog.at_level("WARNING"):
        stats = pipeline.build_index_from_files([docx, str(tmp_path / "bad.pdf"), book]).first()
    assert "bad.pdf" in caplog.text
    assert stats.source_files == ["Book.DOCX", "book.pdf"] and stats.total_chunks == pipeline.index.count
    assert pipeline.query("force on a mass").first().source_file == "Book.DOCX"
    assert pipeline.query("the cell, an organism", 1).first().page_number == 1
    assert pipeline.query("heat", 2).count() == 2 and pipeline.query(" ").count() == 0
    pipeline.save_index(str(tmp_path / "saved"))
    again = RetrievalPipeline(spark, pipeline.settings, EMBEDDER)
    again.load_index(str(tmp_path / "saved"))
    assert [tuple(r) for r in again.query("heat").collect()] == [tuple(r) for r in pipeline.query("heat").collect()]
    assert [r.chunk_id for r in again.index.rows.orderBy("pos").collect()] == list(range(pipeline.index.count))


def test_no_readable_file(pipeline, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\n%")
    for paths in ([str(tmp_path / "bad.pdf")], []):
        with pytest.raises(errors.EmptyDocumentError):
            pipeline.build_index_from_files(paths)


def test_stream_appends_once(spark, tmp_path):
    block = spark.createDataFrame([(0, 0, "s", None, "", "Force moves mass. Heat is not force.")], BLOCKS)
    block.write.parquet(str(tmp_path / "in/one"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in/*"), str(tmp_path / "index"), Chunker(EMBEDDER), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "index/arrived")).count() == 1


def test_streamed_chunks_become_searchable(spark, tmp_path):
    folder = str(tmp_path / "index")

    def arrive(name, text):
        spark.createDataFrame([(0, 0, name, None, "", text)], BLOCKS).write.parquet(str(tmp_path / "in" / name))
        follow(spark, str(tmp_path / "in/*"), folder, Chunker(EMBEDDER), str(tmp_path / "check")).awaitTermination(60)
        made = VectorIndex(spark, EMBEDDER)
        made.load(folder)
        return made

    made = arrive("a", "Force moves mass. Heat is not force.")
    assert [(r.pos, r.source_file) for r in made.rows.collect()] == [(0, "a")]
    made.save(folder)
    made = arrive("b", "The cell of an organism.")
    assert sorted((r.pos, r.source_file) for r in made.rows.collect()) == [(0, "a"), (1, "b")]
    assert made.search("cell", 1).first().source_file == "b"
    made.save(folder)
    assert arrive("c", "A gene.").count == 3


def test_many_paths_are_one_read(spark, tmp_path, docx):
    import time

    for k in range(200):
        (tmp_path / f"f {k}.md").write_text(f"line {k}")
    readers = {".md": lambda c: [(None, 0, c.decode(), False)]}
    paths = [str(tmp_path / f"f {k % 200}.md") for k in range(10_000)]
    began = time.time()
    lines = d.read_lines(spark, paths, readers)
    assert time.time() - began < 60
    got = lines.groupBy("file_pos").count().count(), {(r.file_pos, r.line, r.source_file) for r in lines.where("file_pos IN (3, 403)").collect()}
    assert got == (10_000, {(3, "line 3", "f 3.md"), (403, "line 3", "f 3.md")})
    assert d.read_lines(spark, [f"file://{paths[0]}", f"file:{paths[1]}"], readers).count() == 2
    with pytest.raises(FileNotFoundError, match="none"):
        d.read_lines(spark, [paths[0], str(tmp_path / "none.md"), "x.txt"], readers)


def test_logging_is_set_up_once(capsys):
    import logging

    from candlewick.logs import set_up_logging

    log = logging.getLogger("candlewick")
    try:
        for level in (logging.INFO, logging.WARNING):
            assert set_up_logging(level) is log and len(log.handlers) == 1 and log.level == level
    finally:
        log.handlers.clear()
        log.setLevel(logging.NOTSET)
