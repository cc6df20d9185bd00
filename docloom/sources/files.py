"""File sources: directory scans, text and page formats, path checks."""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import normalize_page, render_table
from docloom.io import written
from docloom.operators.segment import strip_repeated_lines
from docloom.sources.archives import SUFFIXES, open_archives
from docloom.sources.pdf import pages_of

#: Page parsers by backend: bytes of a file to its pages' texts. Register what else is installed (layout parsers, for instance).
PAGE_PARSERS: dict[str, Callable[[bytes], list[str]]] = {"text-layer": pages_of}
DOCUMENT = "identity string, name string, suffix string, hash string, text string, page_count int, pages array<string>"


def register_page_parser(name: str, parser: Callable[[bytes], list[str]]) -> None:
    PAGE_PARSERS[name] = parser


def found_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "txt"), archives: bool = False) -> DataFrame:
    """identity (path under root), name, suffix, hash and content of the files with a parser; with archives, those in tar files count as files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + str(root).split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    suffix = F.lower(F.regexp_extract("identity", r"\.([^./]+)$", 1))
    rows = files.select(F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(base) + 1})").alias("identity"), "content")
    if archives:
        rows = open_archives(rows.where(suffix.isin(*suffixes, *SUFFIXES)))
    return rows.where(suffix.isin(*suffixes)).select("identity", suffix.alias("suffix"), F.sha2("content", 256).alias("hash"), "content", F.element_at(F.split("identity", "/"), -1).alias("name"))


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "txt"), archives: bool = False) -> DataFrame:
    """The found files in path order."""
    return found_files(spark, root, suffixes, archives).orderBy(F.split("identity", "/"))


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for invalid bytes, and LF line ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def parse_text(files: DataFrame) -> DataFrame:
    text = decode_text(F.col("content"))
    return files.where(F.col("suffix") == "txt").select("identity", "name", "suffix", "hash", text.alias("text"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("array<string>").alias("pages"))


def parse_pages(files: DataFrame, backend: str) -> DataFrame:
    """Files of pages through a registered parser, once per file; running lines go, pages are normalised."""
    parser = PAGE_PARSERS[backend]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"identity": part["identity"], "name": part["name"], "suffix": part["suffix"], "hash": part["hash"], "raw": [parser(bytes(c)) for c in part["content"]]})

    # Written, as several branches below read the pages and each would parse all files again.
    raw = written(files.where(F.col("suffix") != "txt").select("identity", "name", "suffix", "hash", "content").mapInPandas(run, "identity string, name string, suffix string, hash string, raw array<string>"), "parsed")
    pages = raw.select("identity", F.posexplode_outer("raw").alias("page", "text"))
    clean = strip_repeated_lines(pages, "identity", "page", "text").withColumn("text", normalize_page(F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    joined = clean.where("page is not null").groupBy("identity").agg(ordered.alias("pages"))
    out = raw.join(joined, "identity", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<string>")))
    return out.select("identity", "name", "suffix", "hash", F.array_join(F.filter("pages", lambda p: p != ""), "\n\n").alias("text"), F.size("pages").alias("page_count"), "pages")


def documents(spark: SparkSession, root: str, backend: str | None = None, archives: bool = False) -> DataFrame:
    """All documents under root; page files need a backend."""
    files = found_files(spark, root, ("txt",) if backend is None else ("txt", "pdf"), archives)
    return parse_text(files) if backend is None else parse_text(files).unionByName(parse_pages(files, backend))


def split_export(markdown: Column, mark: Column, page_count: Column) -> Column:
    """Exactly page_count pages of an export with page marks; too few are padded, too many are an error."""
    parts = F.split(markdown, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1)
    padded = F.concat(parts, F.array_repeat(F.lit(""), F.greatest(page_count - F.size(parts), F.lit(0))))
    return F.when(F.size(parts) > page_count, F.raise_error(F.lit("an export has more pages than its file")).cast("array<string>")).otherwise(padded)


def table_text(rows: Column) -> Column:
    return render_table(rows)


def looks_downloaded(content: Column, least: int, magic: bytes | None = None, marker: str | None = None) -> Column:
    """The check of a download: size, first bytes, and a marker in its text."""
    ok = F.length(content) >= least
    if magic:
        ok = ok & (F.substring(content, 1, len(magic)) == F.lit(magic))
    return ok & content.cast("string").contains(marker) if marker else ok


def resolve_source(root: str, relative: str) -> Path:
    """A file under root by its canonical relative path; anything else is an error."""
    path = PurePosixPath(relative)
    if not relative or path.is_absolute() or ".." in path.parts or str(path) != relative or "\\" in relative:
        raise ValueError(f"{relative!r} is not a canonical relative path")
    found = (Path(root) / relative).resolve()
    if not found.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{relative!r} leaves {root}")
    if not found.is_file():
        raise FileNotFoundError(relative)
    return found


def archive_member(path: str, name: str, least: int = 1) -> str:
    """The text of a tar member by its base name; a missing or too small one is an error."""
    with tarfile.open(path) as tar:
        member = next((m for m in tar if m.isfile() and m.name.rsplit("/", 1)[-1] == name), None)
        if member is None:
            raise FileNotFoundError(name)
        data = tar.extractfile(member).read()
    if len(data) < least:
        raise ValueError(f"{name} has {len(data)} bytes, {least} are needed")
    return data.decode("utf-8", "replace")


def unused_version(path: str) -> str:
    """A name for what is at path now: the next free _vN."""
    p, n = Path(path), 1
    while (candidate := p.with_name(f"{p.stem}_v{n}{p.suffix}")).exists():
        n += 1
    return str(candidate)


def archive_if_exists(path: str) -> str | None:
    """Rename an existing output to the next free version."""
    if not Path(path).exists():
        return None
    target = unused_version(path)
    Path(path).rename(target)
    return target
