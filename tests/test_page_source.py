"""PDF text layers, and pages as a data source."""

import zlib

import pytest

from docloom.sources import files as FS
from docloom.sources import page_source as P
from docloom.sources import pdf


def test_round_trip():
    pages = ["first line\n\n  second  ", "", "Grüße 東京 😀 (brackets) \\ <hex>\nend"]
    assert pdf.pages_of(pdf.pdf_of(pages).encode("ascii")) == pages


def built(stream: bytes, font: bytes = b"", compress: bool = True) -> bytes:
    body = zlib.compress(stream) if compress else stream
    extra = b"/Filter /FlateDecode" if compress else b""
    return b"".join([
        b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/Contents[4 0 R]>>\nendobj\n",
        b"4 0 obj\n<<" + extra + b"/Length %d>>\nstream\r\n" % len(body) + body + b"\nendstream\nendobj\n5 0 obj\n<</Type/Font/Subtype/Type1" + font + b">>\nendobj\n",
    ])


@pytest.mark.parametrize("compress", [True, False])
def test_operators_and_escapes(compress):
    stream = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\)\051 \101\\) Tj 0 -14 Td [(Sp) -20 (lit) -300 (word)] TJ T* <416263> Tj (next) ' 1 0 0 1 72 500 Tm (moved) Tj 10 0 Td ( same) Tj ET % note"
    assert pdf.pages_of(built(stream, compress=compress)) == ["Hello (world)) A\\\nSplit word\nAbc\nnext\nmoved same"]


def test_object_streams_and_maps():
    inner = b"1 0 2 32 <</Type/Catalog/Pages 2 0 R>>   <</Type/Pages/Kids[3 0 R]/Count 1>>"
    packed = zlib.compress(inner)
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <00480069> <02> <0021> endbfchar 1 beginbfrange <10> <11> [<0061> <0062>] endbfrange"
    shown = b"BT /F Tf (\\001\\002\\020\\021\\377) Tj ET".replace(b"/F Tf", b"/F 9 Tf")
    data = b"%PDF-1.5\n7 0 obj\n<</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>\nstream\n" + packed + b"\nendstream\nendobj\n"
    data += b"3 0 obj\n<</Type/Page/Resources<</Font<</F<</ToUnicode 8 0 R>>>>>>/Contents 9 0 R>>\nendobj\n"
    for n, s in ((8, cmap), (9, shown)):
        data += b"%d 0 obj\n<</Length %d>>\nstream\n" % (n, len(s)) + s + b"\nendstream\nendobj\n"
    assert pdf.pages_of(data) == ["Hi!ab�"]


def test_bad_files():
    with pytest.raises(pdf.PdfError):
        pdf.pages_of(b"plain text")
    with pytest.raises(pdf.PdfError):
        pdf.pages_of(b"%PDF-1.4\ntrailer << /Encrypt 3 0 R >>")
    assert pdf.pages_of(b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 9 0 R>>\nendobj") == []


def test_batch_and_stream(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    files = {"a.pdf": ["one", "two"], "sub/b.PDF": ["drei\nvier"]}
    for name, pages in files.items():
        (root / name).write_text(pdf.pdf_of(pages))
    (root / "bad.pdf").write_bytes(b"no pdf")
    (root / "other.txt").write_text("x")
    P.register(spark)
    got = spark.read.format("docloom_pages").option("filesPerPartition", "1").load(str(root))
    assert got.rdd.getNumPartitions() == 3
    rows = {(r.identity, r.name, r.page): r.text for r in got.collect()}
    want = {(n, n.rsplit("/", 1)[-1], i): t for n, pages in files.items() for i, t in enumerate(pages)}
    assert {k: v for k, v in rows.items() if k[2] >= 0} == want and rows["bad.pdf", "bad.pdf", -1].startswith("PdfError")

    def run():
        stream = spark.readStream.format("docloom_pages").load(str(root))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted((r.identity, r.page) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.pdf", 0), ("a.pdf", 1), ("bad.pdf", -1), ("sub/b.PDF", 0)]
    (root / "c.pdf").write_text(pdf.pdf_of(["later"]))
    assert run() == [("a.pdf", 0), ("a.pdf", 1), ("bad.pdf", -1), ("c.pdf", 0), ("sub/b.PDF", 0)]


def test_documents_through_the_text_layer(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(pdf.pdf_of(["HEADER\nbody  one", "HEADER\nbody two", "HEADER\nbody three"]))
    (tmp_path / "b.txt").write_text("plain")
    got = {r.name: (r.page_count, r.pages) for r in FS.documents(spark, str(tmp_path), "text-layer").collect()}
    assert got == {"a.pdf": (3, ["body one", "body two", "body three"]), "b.txt": (None, None)}
