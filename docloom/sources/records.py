"""Record sources: strict and lenient JSON lines, enveloped JSON, rule texts, manifests, event streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schemas import MANIFEST


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a blank line or one that is no object is an error that names its line. A missing file is empty."""
    kind = T._parse_datatype_string(schema)
    try:
        lines = spark.read.text(path, wholetext=False)
    except AnalysisException:
        return spark.createDataFrame([], kind)
    numbered = lines.select(F.col("value"), F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__id"))
    # Numbers are exact within a file that is one split; ids only say where a bad line is.
    first = numbered.groupBy("__f").agg(F.min("__id").alias("__first"))
    rows = numbered.join(F.broadcast(first), "__f").withColumn("__line", F.col("__id") - F.col("__first") + 1)
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    checked = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("__line").cast("string"), F.lit(" is not a JSON object"))))
    return rows.select(F.from_json(checked, kind).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file without its blank lines."""
    return spark.read.schema(schema).json(path)


def read_enveloped(spark: SparkSession, path: str, schema: str, list_field: str, allowed: set[str] | None = None) -> DataFrame:
    """The rows of a list inside one JSON document; unknown top-level keys are an error if allowed is given."""
    raw = spark.read.text(path, wholetext=True)
    if allowed is not None:
        extra = [k for r in raw.select(F.explode(F.json_object_keys("value")).alias("k")).collect() if (k := r.k) not in allowed]
        if extra:
            raise ValueError(f"unknown keys: {extra}")
    doc = raw.select(F.from_json("value", f"{list_field} array<struct<{_fields(schema)}>>", {"mode": "FAILFAST"}).alias("d"))
    return doc.select(F.explode(f"d.{list_field}").alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The index manifest; whatever is wrong with it gives an empty one, which forces a rebuild."""
    empty = spark.createDataFrame([], MANIFEST)
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return empty
    wanted = T._parse_datatype_string(MANIFEST)
    if {(f.name, f.dataType) for f in found.schema} != {(f.name, f.dataType) for f in wanted}:
        return empty
    bad = found.where("identity is null or hash is null or chunk_count is null or chunk_count < 0 or page_count < 0").limit(1)
    doubled = found.groupBy("identity").count().where("count > 1").limit(1)
    return empty if not bad.isEmpty() or not doubled.isEmpty() else found.select(*wanted.names)


def parse_rules(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """sid and rule of lines that are neither blank nor comments; of a sid the first line counts."""
    own = lines.select(F.trim(line).alias("rule"), F.col(number).alias("__n")).where("rule <> '' and rule not like '#%'")
    sid = F.regexp_extract("rule", r"\bsid:(\d+)\s*;", 1)
    rows = own.where(sid != "").select(sid.cast("long").alias("sid"), "rule", "__n")
    first = Window.partitionBy("sid").orderBy("__n")
    return rows.withColumn("__p", F.row_number().over(first)).where("__p = 1").select("sid", "rule")


def rule_file(gid: Column, sid: Column, rule: Column) -> Column:
    """The text of a rule's file: a header line and the rule."""
    return F.concat(F.lit("Rule "), gid.cast("string"), F.lit(":"), sid.cast("string"), F.lit("\n\n"), rule, F.lit("\n"))


def url_key(url: Column) -> Column:
    """struct(gid, sid) from a url's end; an error if it has none."""
    pattern = r"/(\d+)-(\d+)/?$"
    found = F.struct(F.regexp_extract(url, pattern, 1).cast("int").alias("gid"), F.regexp_extract(url, pattern, 2).cast("int").alias("sid"))
    return F.when(url.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("no rule key in "), url)).cast("struct<gid:int,sid:int>"))


def rule_sources(entries: DataFrame, url: str = "rule_documentation.url") -> DataFrame:
    """Distinct urls with their keys, in key order; entries without one are skipped."""
    own = entries.select(F.col(url).alias("url")).where("url is not null").distinct()
    return own.select(url_key(F.col("url")).alias("k"), "url").select("k.gid", "k.sid", "url").orderBy("gid", "sid", "url")


EVENT = "event string, stage string, t double, text string, payload string, error string"


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events of a JSON-lines stream, batch or streaming; blank lines are skipped and an error event raises."""
    rows = lines.where(F.trim(line) != "").select(F.from_json(line, EVENT).alias("e")).select("e.*")
    failed = F.when(F.col("event") == "error", F.raise_error(F.coalesce("error", F.lit("stream failed")))).otherwise(F.col("event"))
    return rows.withColumn("event", failed.cast("string"))


def encode_events(events: DataFrame) -> DataFrame:
    """One compact JSON object a row, without null fields."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def progress(events: DataFrame, key: str = "stage", order: str = "t") -> DataFrame:
    """The last event of each stage."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("__e")).select(key, "__e.*")


def load_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Questions of the evaluation dataset: exactly the keys version and questions."""
    return read_enveloped(spark, path, schema, "questions", {"version", "questions"})


def load_corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_enveloped(spark, path, "path string, sha256 string, page_count int", "documents", {"version", "documents"})
