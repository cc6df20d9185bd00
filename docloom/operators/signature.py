"""Signatures of tables that follow changes: an order-free hash of all rows, kept by part.

A row counts with the SHA-256 of its key and content hash, cut into four numbers of 60 bits; a part (one of 256, by
the key) has the exact sums of its rows' numbers. So rows that come and go are added to and taken from the sums, the other
rows are not read, and the order of rows does not matter. Parts that differ between two tables tell where to look.

FileSignatures does this for a folder of Parquet files: each file's sums are kept under its name, length and time,
so a table is found unchanged by listing it, and a changed one is signed by reading its new files only.
"""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = ("s0", "s1", "s2", "s3")
#: Plain SQL, so other engines can follow it. {k} and {h} are SQL expressions of key and content hash.
ROW_HASH = "sha2(concat(coalesce(concat('k', {k}), 'n'), '\\t', coalesce(concat('h', {h}), 'n')), 256)"
_PART = "substring(md5(coalesce({k}, '')), 1, 2)"


def _lanes(row_hash: str) -> list[str]:
    return [f"cast(coalesce(sum(cast(conv(substring({row_hash}, {15 * i + 1}, 15), 16, 10) as decimal(20,0))), 0) as decimal(38,0)) as {s}" for i, s in enumerate(LANES)]


def signature_parts(rows: DataFrame, key: str, content_hash: str) -> DataFrame:
    """part, n and the sums of each part that has rows. Null keys and hashes count as such."""
    own = rows.selectExpr(f"cast(`{key}` as string) as k", f"`{content_hash}` as h").selectExpr(f"{_PART.format(k='k')} as part", f"{ROW_HASH.format(k='k', h='h')} as r")
    return own.groupBy("part").agg(F.count("*").alias("n"), *[F.expr(x) for x in _lanes("r")])


def follow(parts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The parts after some rows came and others went (both as signature_parts); an updated row is in both."""
    gone = removed.selectExpr("part", "-n as n", *[f"cast(-{s} as decimal(38,0)) as {s}" for s in LANES])
    after = parts.unionByName(added).unionByName(gone).groupBy("part").agg(F.sum("n").alias("n"), *[F.expr(f"cast(sum({s}) as decimal(38,0)) as {s}") for s in LANES])
    return after.where(" or ".join(f"{c} <> 0" for c in ("n", *LANES)))


def differing_parts(one: DataFrame, other: DataFrame) -> DataFrame:
    """Parts whose rows differ."""
    each = one.unionByName(other.selectExpr("part", "-n as n", *[f"cast(-{s} as decimal(38,0)) as {s}" for s in LANES]))
    sums = each.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", *LANES)])
    return sums.where(" or ".join(f"{c} <> 0" for c in ("n", *LANES))).select("part")


def root(parts: DataFrame) -> DataFrame:
    """One row: signature and count of the whole table."""
    total = parts.agg(F.expr("coalesce(sum(n), 0) as count"), *[F.expr(f"coalesce(sum({s}), 0) as {s}") for s in LANES])
    return total.selectExpr(f"sha2(concat_ws(':', count, {', '.join(LANES)}), 256) as signature", "cast(count as bigint) as count")


class FileSignatures:
    """Sums of the files of Parquet tables, kept as a table under path; one folder for one way of signing."""

    SCHEMA = "name string, n bigint, " + ", ".join(f"{s} decimal(38,0)" for s in LANES)

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, table: str) -> dict[str, str]:
        """Of each data file of a table: a name that changes with its content, and its path."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found, todo = {}, [fs.getFileStatus(path)]
        while todo:
            status = todo.pop()
            at = status.getPath()
            if status.isDirectory():
                todo += fs.listStatus(at)
            elif not at.getName().startswith(("_", ".")):
                about = f"{at.toString()} {status.getLen()} {status.getModificationTime()}"
                found[hashlib.md5(about.encode(), usedforsecurity=False).hexdigest()] = at.toString()
        return found

    def _known(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/files")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/files")

    def sign(self, table: str, key: str, content_hash: str) -> tuple[str, int, int]:
        """Signature, number of rows and number of files read of a Parquet table; content_hash is SQL over its columns.

        One row a file reaches the driver, as the list of files does in any scan.
        """
        files = self._files(table)
        known = {r.name: tuple(r)[1:] for r in self._known().distinct().collect() if r.name in files}
        new = {n: p for n, p in files.items() if n not in known}
        if new:
            rows = self.spark.read.parquet(*sorted(new.values())).selectExpr("_metadata.file_path as f", f"cast(`{key}` as string) as k", f"{content_hash} as h")
            sums = rows.selectExpr("f", f"{ROW_HASH.format(k='k', h='h')} as r").groupBy("f").agg(F.count("*").alias("n"), *[F.expr(x) for x in _lanes("r")])
            plain = lambda p: re.sub("^[a-z]+:/+", "/", unquote(p))  # noqa: E731  the column has paths as addresses
            by_path = {plain(r.f): tuple(r)[1:] for r in sums.collect()}
            found = {n: by_path.get(plain(p), (0, 0, 0, 0, 0)) for n, p in new.items()}  # a file without rows has no sums
            self.spark.createDataFrame([(n, int(v[0]), *(Decimal(int(x)) for x in v[1:])) for n, v in found.items()], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/files")
            known |= found
        count, *lanes = (sum(int(v[i]) for v in known.values()) for i in range(5))
        return hashlib.sha256(":".join(map(str, (count, *lanes))).encode()).hexdigest(), count, len(new)


def signed(spark: SparkSession, signature: str, count: int) -> DataFrame:
    """signature and count as the one-row table that an index is saved with."""
    return spark.createDataFrame([(signature, count)], "signature string, count bigint")
