"""PDF files made by hand, read as text."""

import hashlib
import zlib

import pytest

from loomgraph.plans import catalog
from loomgraph.sources.files import Loaders, load, scan
from loomgraph.sources.pdf import pdf_text


def made(*objects: bytes) -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, x) for i, x in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data: bytes, how: bytes = b"") -> bytes:
    if how == b"/FlateDecode":
        data = zlib.compress(data)
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter " + how if how else b"", data)


PAGES = (b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>")


def sample() -> bytes:
    first = rb"BT /F1 12 Tf 72 700 Td (Pumps \(large\) use ) Tj [(va) -20 (lves) -400 (daily\056)] TJ 0 -14 Td (Second line) Tj ET % note" b"\n"
    second = b"BT /F2 10 Tf <00010002> Tj T* <0003> Tj ET"
    table = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <00E9> endbfchar 1 beginbfrange <0001> <0002> <0041> endbfrange endcmap"
    return made(*PAGES, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", stream(first, b"/FlateDecode"), stream(second), b"<< /Type /Font >>", b"<< /Type /Font /ToUnicode 9 0 R >>", stream(table, b"/FlateDecode"))


def test_text_of_pages():
    assert pdf_text(sample()) == "Pumps (large) use valves daily.\nSecond line\n\nAB\né"


def test_objects_in_streams():
    inner = b"1 0 2 37 " + b"<< /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Kids [3 0 R] /Count 1 >>"
    data = b"%PDF-1.7\n3 0 obj << /Type /Page /Contents 4 0 R >> endobj\n4 0 obj " + stream(b"BT (packed) Tj ET") + b" endobj\n5 0 obj "
    packed = zlib.compress(inner)
    data += b"<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj" % (len(packed), packed)
    assert pdf_text(data) == "packed"


def test_odd_files():
    assert pdf_text(made(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] >>")) == "" and pdf_text(b"%PDF-1.4 nothing") == ""
    with pytest.raises(ValueError, match="not a PDF"):
        pdf_text(b"text")
    with pytest.raises(ValueError, match="encrypted"):
        pdf_text(sample().replace(b"trailer <<", b"trailer << /Encrypt 3 0 R"))


def test_files_are_loaded(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample())
    (tmp_path / "b.pdf").write_bytes(b"broken")
    documents, rejects = load(scan(spark, str(tmp_path)), Loaders())
    assert [(r["path"], r["text"].split("\n")[0]) for r in documents.collect()] == [("a.pdf", "Pumps (large) use valves daily.")]
    assert [(r["path"], r["reason"]) for r in rejects.collect()] == [("b.pdf", "ValueError: not a PDF file")]


def test_files_of_other_formats_are_not_opened(spark, tmp_path):
    """Text files are read once, not again to look for files that need a parser; names may hold blanks and signs."""
    for name in ("a b.md", "c+d%20.Txt", "é.md", "e.png", "md"):
        (tmp_path / name).write_text(name)
    files = scan(spark, str(tmp_path))
    documents, _ = load(files)
    assert not files.filter("suffix in ('.pdf', '.docx')").rdd.getNumPartitions()  # what load parses: no file, no task
    assert {(r["path"], r["suffix"], r["text"]) for r in documents.collect()} == {(x, x[x.rindex(".") :].lower(), x) for x in ("a b.md", "c+d%20.Txt", "é.md")}


def test_empty_files_are_files_and_any_path_comes_back(spark, tmp_path):
    """Spark makes no row of an empty file; documents may share a path, have none, or one that is hidden or leads elsewhere."""
    (tmp_path / "raw" / "b").mkdir(parents=True)
    for name, text in (("e +%20é.md", ""), ("b/full.md", "x"), ("b/none.txt", ""), ("other.png", "")):
        (tmp_path / "raw" / name).write_text(text)
    files = scan(spark, str(tmp_path / "raw"))
    assert {(r["path"], r["text"]) for r in load(files)[0].collect()} == {("e +%20é.md", ""), ("b/full.md", "x"), ("b/none.txt", "")}
    assert {(r["path"], r["size"]) for r in files.collect()} == {("e +%20é.md", 0), ("b/full.md", 1), ("b/none.txt", 0)}
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (2, None, "s"), (3, "", "s"), (None, "c", "s"), (4, "d", None), (5, "e", ".."), (6, "f", "_h/.i"), (7, "g", "k-v w+%41*" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    want = [(None if n is None or s is None else f"{s}/{n}.md", ".md", "md", digest(t), digest(t)) for n, t, s in rows]
    got = catalog.QUERIES["files_scanned"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
