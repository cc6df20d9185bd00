"""Many documents as files in few archives."""

import os
import time
from pathlib import Path

from conftest import same_rows
from pyspark.sql import functions as F
from test_round3 import documents_of, folder_of

from docloom import catalog
from docloom.io import shared_dir
from docloom.sources import archives as A
from docloom.sources import files as FS
from docloom.sources import page_source as P
from docloom.sources import pdf


def test_few_files_of_many_documents(spark, tmp_path):
    """rows as the SQL has them, of odd ids, sources and texts, from a few files."""
    texts = ["one\r\ntwo\rthree\n", "", None, "ünïcode \U0001f600", "x" * 5000] * 60
    rows = documents_of(texts, [i if i % 7 else -i for i in range(len(texts))])
    rows = [r | {"source": ("a b", "c/d=e%", None, "ü", "")[i % 5]} for i, r in enumerate(rows)]
    folder = folder_of(tmp_path, documents=rows)
    for name, parts in {"file_scan": "files", "text_documents": "files", "page_documents": "pdf", "pdf_pages": "pdf"}.items():
        before = set(Path(shared_dir(spark)).glob(f"docloom-{parts}-*"))
        same_rows(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)
        new = set(Path(shared_dir(spark)).glob(f"docloom-{parts}-*")) - before
        assert 0 < sum(len(files) for d in new for _, _, files in os.walk(d)) <= 8


def test_archives_and_loose_files(spark, tmp_path):
    files = spark.createDataFrame([("sub/a.txt", b"one"), ("b.TXT", b"\xff"), ("c.pdf", pdf.pdf_of(["p"]).encode()), ("same.txt", b"1"), ("same.txt", b"2"), ("big.txt", b"z" * 900), ("no", b"")], "path string, content binary").coalesce(1)
    A.write_archives(files, f"{tmp_path}/deep", most=500)
    assert len(os.listdir(tmp_path / "deep")) > 1
    (tmp_path / "deep" / "loose.txt").write_bytes(b"loose")
    got = sorted((r.identity, r.name, r.suffix, bytes(r.content)) for r in FS.scan(spark, str(tmp_path), ("txt",), archives=True).collect())
    assert got == sorted((f"deep/{n}", n.split("/")[-1], "txt", c) for n, c in [("sub/a.txt", b"one"), ("b.TXT", b"\xff"), ("same.txt", b"1"), ("same.txt", b"2"), ("big.txt", b"z" * 900), ("loose.txt", b"loose")])
    assert [r.identity for r in FS.scan(spark, str(tmp_path)).collect()] == ["deep/loose.txt"]
    P.register(spark)
    pages = spark.read.format("docloom_pages").option("archives", "true").load(str(tmp_path))
    assert [(r.identity, r.page, r.text) for r in pages.collect()] == [("deep/c.pdf", 0, "p")]
    A.write_archives(files.where(F.lit(False)), f"{tmp_path}/none")
    assert FS.scan(spark, f"{tmp_path}/none", archives=True).count() == 0


def test_long_runs_of_digits(spark):
    """a string of digits is passed once, not once from each of its digits."""
    start = time.process_time()
    assert pdf.pages_of(pdf.pdf_of(["1" * 40_000]).encode()) == ["1" * 40_000]
    assert time.process_time() - start < 5
