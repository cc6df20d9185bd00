"""The chunk store: versions of Parquet files, its manifest, paging and joins, and the incremental index."""

from __future__ import annotations

import json
import re
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.io import drop_written, written
from docloom.operators.snapshots import FEW_DOCS, Change, Snapshot, SnapshotLog
from docloom.schemas import CHUNK, MANIFEST


def counts(chunks: DataFrame, doc: str = "doc_name") -> DataFrame:
    return chunks.groupBy(doc).agg(F.count("*").alias("chunk_count")).orderBy(doc)


def totals(chunks: DataFrame, doc: str = "doc_name") -> DataFrame:
    """One row: documents and chunks."""
    return chunks.groupBy(doc).count().agg(F.count("*").alias("documents"), F.coalesce(F.sum("count"), F.lit(0)).alias("chunks"))


def duplicate_names(files: DataFrame, name: str = "name") -> DataFrame:
    return files.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").orderBy(name)


def numeric_suffix(key: Column) -> Column:
    """The number after an id's last colon, null for a malformed id."""
    last = F.element_at(F.split(key, ":"), -1)
    return F.when(key.contains(":") & last.rlike(r"^[+-]?\d+$"), last.cast("long"))


def page_of(chunks: DataFrame, key: str, limit: int, offset: int, document: str | None = None, doc: str = "doc_name") -> tuple[DataFrame, int]:
    """A page in numeric-suffix order, malformed ids last, and the number of all rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be in 1 .. 200 and offset not negative")
    own = chunks if document is None else chunks.where(F.col(doc) == document)
    n = numeric_suffix(F.col(key))
    return own.orderBy(n.isNull(), n, key).offset(offset).limit(limit), own.count()


#: Rows of a file of a page index, and of a range unless it is told.
RANGE_ROWS = 100_000


def build_page_index(chunks: DataFrame, key: str, path: str, rows: int = RANGE_ROWS) -> None:
    """Write chunks in numeric-suffix order to files, each row with its place in its file, then the files with the rows before each.

    A range is so many rows of a file, which a page is read from. Files follow RANGE_ROWS, however small the ranges are: tasks,
    folders and the keys that are sampled for the order follow their number.
    """
    spark = chunks.sparkSession
    files = max(1, -(-chunks.count() // max(rows, RANGE_ROWS)))
    n = numeric_suffix(F.col(key))
    own = chunks.select("*", n.isNull().alias("__bad"), n.alias("__n")).repartitionByRange(files, "__bad", "__n", key)
    own = own.withColumn("__file", F.spark_partition_id()).sortWithinPartitions("__file", "__bad", "__n", key)
    own = own.withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("__bad", "__n")
    own.write.mode("overwrite").option("parquet.page.row.count.limit", min(rows, 20_000)).partitionBy("__file").parquet(f"{path}/rows")
    schema = T.StructType([*chunks.schema.fields, T.StructField("__place", T.LongType()), T.StructField("__file", T.IntegerType())])
    sizes = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("__file").agg(F.count("*").alias("rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    kept = [F.lit(rows).alias("range_rows"), F.lit(schema.json()).alias("schema")]
    sizes.select("__file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), *kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def indexed_page(spark: SparkSession, path: str, key: str, limit: int, offset: int) -> tuple[DataFrame, int, int]:
    """As page_of, from a page index: the page, the number of all rows, and the number of ranges read (few, however deep)."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be in 1 .. 200 and offset not negative")
    files = spark.read.parquet(f"{path}/files")
    total = files.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    near = files.where(f"before < {offset + limit} and before + rows > {offset}").orderBy("__file").collect()  # limit + 2 at most
    if not near:
        kept = files.select("schema").first()
        return spark.createDataFrame([], T.StructType(T.StructType.fromJson(json.loads(kept.schema)).fields[:-2]) if kept else f"{key} string"), total, 0
    wanted, ranges = F.lit(False), 0
    for r in near:
        first, last = max(offset - r.before, 0), min(offset + limit - r.before, r["rows"]) - 1
        wanted = wanted | ((F.col("__file") == r["__file"]) & F.col("__place").between(first, last))
        ranges += last // r.range_rows - first // r.range_rows + 1
    rows = spark.read.schema(T.StructType.fromJson(json.loads(near[0].schema))).parquet(f"{path}/rows").where(wanted)
    return rows.orderBy("__file", "__place").drop("__place", "__file"), total, ranges


def filtered(page: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of a page in which any column has the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return page.where(hit)


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows of these ids; unknown ones are silently absent."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi")


def in_order(chunks: DataFrame, ids: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    return chunks.join(ids.select(key, place), key).orderBy(place)


def keyed_upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace the old ones of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def pending(left: DataFrame, right: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Combinations of two small lists whose keys are not done: the work left after a stop."""
    return left.crossJoin(right).join(done.select(*keys).distinct(), list(keys), "left_anti")


def manifest_states(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """identity and state: added, updated or skipped for files (identity, hash), removed for manifest entries without one."""
    m = manifest.select(F.col("identity").alias("__i"), F.col("hash").alias("__h"))
    both = files.select("identity", "hash").join(m, F.col("identity") == F.col("__i"), "full_outer")
    state = F.when(F.col("identity").isNull(), "removed").when(F.col("__i").isNull(), "added").when(F.col("hash") == F.col("__h"), "skipped").otherwise("updated")
    return both.select(F.coalesce("identity", "__i").alias("identity"), state.alias("state"))


def count_differences(expected: DataFrame, stored: DataFrame, key: str = "doc_name", n: str = "chunk_count") -> DataFrame:
    """Documents whose expected and stored counts differ; empty if the maps are equal."""
    e, s = expected.select(F.col(key).alias("__e"), F.col(n).alias("__n")), stored.select(F.col(key).alias("__s"), F.col(n).alias("__m"))
    both = e.join(s, F.col("__e") == F.col("__s"), "full_outer")
    return both.where(~F.col("__n").eqNullSafe(F.col("__m"))).select(F.coalesce("__e", "__s").alias(key), F.col("__n").alias("expected"), F.col("__m").alias("stored"))


def missing_models(supported: DataFrame, installed: DataFrame, name: str = "name") -> DataFrame:
    """Supported names, in order, each with whether it is installed."""
    own = installed.select(F.col(name).alias("__n")).distinct()
    return supported.join(own, F.col(name) == F.col("__n"), "left").select("place", name, F.col("__n").isNotNull().alias("installed")).orderBy("place")


def swap_table(df: DataFrame, path: str) -> None:
    """Replace the table at path: written aside first, then renamed into place; the old one comes back if that fails.

    Between the two renames a reader that starts anew finds no table and has to try again.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    staged, old = f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    to = jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(to(path))
    if had and not fs.rename(to(path), to(old)):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(to(staged), to(path)):
        if had:
            fs.rename(to(old), to(path))
        raise OSError(f"{staged} could not be renamed to {path}")
    fs.delete(to(old), True)


class Busy(RuntimeError):
    """Another rebuild is running."""


_lock = threading.Lock()


@contextmanager
def one_at_a_time():
    """A second indexing run in this driver fails at once and does not wait."""
    if not _lock.acquire(blocking=False):
        raise Busy("an indexing run is in progress")
    try:
        yield
    finally:
        _lock.release()


def check_request(question: str, model: str, models: tuple[str, ...], temperature: float = 0.0, top_k: int = 5) -> None:
    """The rules of an answer request; the first broken one is raised."""
    if not question.strip():
        raise ValueError("question must not be blank")
    if model not in models:
        raise ValueError(f"unknown model {model!r}")
    if not 0 <= temperature <= 2:
        raise ValueError("temperature must be in 0 .. 2")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be in 1 .. 20")


@dataclass(frozen=True)
class IndexResult:
    documents: int
    chunks: int
    added: int
    updated: int
    skipped: int
    removed: int


def _doc_hash(name: Column) -> Column:
    return F.xxhash64(name)


class ChunkStore:
    """Chunks with vectors and their manifest, as versions of two tables that change together (docloom.operators.snapshots).

    Files are ranges of a hash of the document's name; their number follows the bytes written and a hot document is
    split by its chunks' ids. A change rewrites only the files that hold a changed document.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = SnapshotLog(spark, self.path)
        self.schema = f"{CHUNK}, embedding array<float>"
        self.columns = dict(c.split() for c in self.schema.split(", "))

    def version(self) -> int:
        return self.log.version()

    def chunks(self, version: int | None = None) -> DataFrame:
        return self.log.read("chunks", self.schema, version)

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.log.read("manifest", MANIFEST, version)

    def write_documents(self, chunks: DataFrame) -> None:
        """Append or replace whole documents."""
        self.replace_documents(chunks.select("doc_name").distinct(), chunks)

    def delete_documents(self, names: DataFrame) -> None:
        """Drop the chunks of these documents (doc_name)."""
        self.replace_documents(names, None)

    def replace_documents(self, names: DataFrame, chunks: DataFrame | None) -> int:
        """Put chunks in the place of these documents' chunks, in one commit; the version.

        A build that fails commits nothing. If another writer commits first, only the files that it touched are read again.
        """
        named = names.select("doc_name").distinct().persist()
        fresh = self.log.write(self._arranged(chunks)) if chunks is not None else {}
        docs = self._hashes(named)
        try:
            return self.log.transact(lambda base: self._replacing(base, named, fresh, docs))
        finally:
            named.unpersist()

    def compact(self, least: int = 64 << 20) -> int | None:
        return self.log.compact("chunks", self.schema, self._arranged, least)

    def _hashes(self, named: DataFrame) -> frozenset[int] | None:
        """Hashes of a few documents; None stands for any."""
        found = named.select(_doc_hash(F.col("doc_name")).alias("h")).limit(FEW_DOCS + 1).collect()
        return None if len(found) > FEW_DOCS else frozenset(r.h for r in found)

    def _full(self, chunks: DataFrame) -> DataFrame:
        return chunks.selectExpr(*[f"cast({c if c in chunks.columns else 'null'} as {kind}) as {c}" for c, kind in self.columns.items()])

    def _built(self, chunks: DataFrame) -> dict[str, int]:
        """New files of chunks that are yet to be computed. Ranges are sampled first, so what is sampled is written before: nothing is parsed or embedded twice."""
        staged = written(self._full(chunks), "chunks")
        try:
            return self.log.write(self._arranged(staged))
        finally:
            drop_written(staged)

    def _arranged(self, chunks: DataFrame) -> DataFrame:
        h = _doc_hash(F.col("doc_name"))
        return self._full(chunks).repartitionByRange(h, "id").sortWithinPartitions(h, "id")

    def _replacing(self, base: Snapshot, named: DataFrame, fresh: dict[str, int], docs: frozenset[int] | None) -> Change:
        files = base.files.get("chunks", {})
        touched: list[str] = []
        if files:  # of the stored chunks only the column of names is read
            found = self.log.read_files(files, self.schema).select("doc_name", F.col("_metadata.file_path").alias("f")).join(named, "doc_name", "left_semi")
            touched = sorted(re.search(r"data/[^/]+/[^/]+$", r.f)[0] for r in found.select("f").distinct().collect())
        rest = self.log.write(self._arranged(self.log.read_files(touched, self.schema).join(named, "doc_name", "left_anti"))) if touched else {}
        return Change({"chunks": rest | fresh}, {"chunks": touched}, docs)

    def save_manifest(self, manifest: DataFrame) -> None:
        added = self._manifest_files(manifest)
        self.log.transact(lambda base: Change({"manifest": added}, {"manifest": sorted(base.files.get("manifest", {}))}))

    def _manifest_files(self, manifest: DataFrame) -> dict[str, int]:
        return self.log.write(manifest.select(*[c.split()[0] for c in MANIFEST.split(", ")]).repartitionByRange("identity").sortWithinPartitions("identity"))

    def reset(self) -> None:
        """A version without chunks; earlier ones can still be read."""
        self.log.transact(lambda base: Change({}, {t: sorted(f) for t, f in base.files.items()}, None))

    def index(self, files: DataFrame, build, force: bool = False, on_progress=None) -> IndexResult:
        with one_at_a_time():
            return self._index(files, build, force, on_progress)

    def _index(self, files: DataFrame, build, force: bool, on_progress) -> IndexResult:
        """Bring the store up to date with files (identity, name, hash, ...) in one commit, so readers see all of it or nothing.

        build(files) gives the chunks with vectors of changed files only; unchanged ones are never parsed. Files
        of equal names are an error. The store is rebuilt if its counts do not agree with its manifest.
        """
        tell = on_progress or (lambda _: None)
        doubled = [r[0] for r in duplicate_names(files).limit(5).collect()]
        if doubled:
            raise ValueError(f"file names must be unique: {', '.join(doubled)}")
        done: dict[str, int] = {}

        def attempt(base: Snapshot) -> Change:
            manifest = self.log.read_files(base.files.get("manifest", {}), MANIFEST).withColumn("doc_name", F.element_at(F.split("identity", "/"), -1))
            stored = self.log.read_files(base.files.get("chunks", {}), self.schema)
            expected = manifest.where("chunk_count > 0").groupBy("doc_name").agg(F.sum("chunk_count").alias("chunk_count"), F.count("*").alias("__n"))
            anew = force or not expected.where("__n > 1").isEmpty() or not count_differences(expected, counts(stored)).isEmpty()
            if anew:
                tell("rebuilding")
                manifest = manifest.limit(0)
            states = manifest_states(files, manifest).persist()
            try:
                return self._indexing(base, files, build, manifest, states, anew, done, tell)
            finally:
                states.unpersist()

        version = self.log.transact(attempt)
        return IndexResult(self.manifest(version).count(), self.chunks(version).count(), *(done.get(s, 0) for s in ("added", "updated", "skipped", "removed")))

    def _indexing(self, base: Snapshot, files: DataFrame, build, manifest: DataFrame, states: DataFrame, anew: bool, done: dict[str, int], tell) -> Change:
        done.clear()
        done.update({r.state: r["count"] for r in states.groupBy("state").count().collect()})
        tell(f"{done.get('added', 0)} new, {done.get('updated', 0)} changed, {done.get('skipped', 0)} unchanged")
        if not anew and done.keys() <= {"skipped"}:
            return Change({}, {})
        changed = files.join(states.where("state in ('added', 'updated')"), "identity", "left_semi")
        kept = manifest.join(states.where("state = 'skipped'"), "identity", "left_semi").select("identity", "hash", "page_count", "chunk_count")
        fresh: dict[str, int] = {}
        if done.get("added", 0) + done.get("updated", 0):
            fresh = self._built(build(changed))
            sizes = self.log.read_files(fresh, self.schema).groupBy("doc_name").agg(F.count("*").cast("int").alias("chunk_count"))
            pages = F.col("page_count") if "page_count" in changed.columns else F.lit(None).cast("int")
            new = changed.select("identity", "hash", pages.alias("page_count"), "name").join(sizes, F.col("name") == F.col("doc_name"), "left")
            kept = kept.unionByName(new.select("identity", "hash", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")))
        gone = states.where("state = 'removed'").select(F.element_at(F.split("identity", "/"), -1).alias("name")).join(files.select("name"), "name", "left_anti")
        named = changed.select(F.col("name").alias("doc_name")).unionByName(gone.select(F.col("name").alias("doc_name"))).distinct().persist()
        if anew:
            change = Change({"chunks": fresh}, {"chunks": sorted(base.files.get("chunks", {}))}, None)
        else:
            change = self._replacing(base, named, fresh, self._hashes(named))
        change = Change(change.add | {"manifest": self._manifest_files(kept)}, change.remove | {"manifest": sorted(base.files.get("manifest", {}))}, change.docs)
        named.unpersist()
        return change


def ranked(df: DataFrame, partition: str, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
