"""Segmentation queries. Invented prose has no headings, so a fixed rule makes some lines headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import line_signature, lines, nfkc, normalize_page, title_of, upper_by_character
from docloom.io import table
from docloom.operators.segment import chunk_documents, heading_blocks, repeated_lines, split_text, strip_repeated_lines


def short_line_heading(line: Column) -> Column:
    """Lines of at most 12 characters that end with a full stop: depth 4, 5 or 6 by length; depth 4 names a control."""
    depth = 4 + F.length(line) % 3
    is_heading = line.endswith(".") & (F.length(line) <= 12) & ~line.contains("..")
    return F.when(is_heading, F.struct(depth.cast("int").alias("depth"), line.alias("label"), F.when(depth == 4, upper_by_character(line)).alias("control_id")))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = heading_blocks(_pages(spark, d), "doc_id", "page", "text", short_line_heading)
    return blocks.select("doc_id", "block", "h4", "h5", "h6", "control_id", F.sha2("text", 256).alias("text_hash"))


def _source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a document whose pages have a running line at the top and a page stamp at the end."""
    page = F.concat(F.lit("COLLECTION  "), F.coalesce("source", F.lit("none")), F.lit(" 7\n"), "text", F.lit("\nsheet "), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", page.alias("text"))


def q_furniture(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(_source_pages(spark, d), "source", "doc_id", "text")


def q_strip(spark: SparkSession, d: str) -> DataFrame:
    return strip_repeated_lines(_source_pages(spark, d), "source", "doc_id", "text").select("source", "doc_id", F.sha2("text", 256).alias("text_hash"))


def q_split(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.posexplode(split_text(F.col("text"), 400, 60)).alias("n", "passage"))
    return own.select("doc_id", "n", F.length("passage").alias("length"), F.sha2("passage", 256).alias("text_hash"))


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_documents(_pages(spark, d), "doc_id", "page", "text", matcher=short_line_heading)
    return chunks.select("id", "doc_id", "section", "control_id", "content_hash", F.length("text").alias("length"))


def q_signatures(spark: SparkSession, d: str) -> DataFrame:
    """How many lines and distinct line signatures each document has."""
    own = table(spark, d, "documents").select("doc_id", F.transform(lines(F.col("text")), line_signature).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_lines"), F.size(F.array_distinct("s")).cast("long").alias("n_signatures"))


def q_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(normalize_page(F.col("text"), compatibility=False), 256).alias("text_hash"), F.sha2("text", 256).alias("content_hash"), title_of(F.col("text")).alias("title"))


def q_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(nfkc(F.col("text")), 256).alias("text_hash"))


QUERIES = {"heading_blocks": q_blocks, "line_furniture": q_furniture, "strip_furniture": q_strip, "split_text": q_split, "chunk_hashes": q_chunks, "line_signatures": q_signatures, "normalized_text": q_normalized, "nfkc_text": q_nfkc}

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SIG = "regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')"
_LINES = "(case when text = '' then []::varchar[] when ends_with(text, chr(10)) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end)"
_RUNNING = f"""documents as (select source, doc_id, 'COLLECTION  ' || coalesce(source, 'none') || ' 7' || chr(10) || text || chr(10) || 'sheet ' || doc_id as text from main.documents),
l as (select source, doc_id, list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as a from documents),
e as (select source, doc_id, unnest(list_transform(range(1, least(len(a), 5) + 1), lambda i: {{'line': a[i], 'slot': i - 1}}) || list_transform(range(greatest(len(a) - 4, 1), len(a) + 1), lambda i: {{'line': a[i], 'slot': i - len(a) - 1}})) as x from l),
c as (select source, regexp_replace(x.line, '[0-9]+', '#', 'g') as signature, count(distinct doc_id) as pages, count(distinct x.slot) as slots, count(distinct x.line) as forms from e group by 1, 2),
p as (select source, count(distinct doc_id) as total from documents group by 1 having total >= 3),
running as (select c.source, signature from c join p on c.source is not distinct from p.source where pages * 2 >= total or (pages >= 3 and slots = 1 and forms = pages))"""
_BLOCKS = """raw as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line, len(string_split(text, chr(10))) as n from documents where text <> ''),
lines as (select doc_id, line, case when line < n then body || chr(10) else body end as text, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as s from raw where not (line = n and body = '')),
h as (select *, case when ends_with(s, '.') and length(s) <= 12 and not contains(s, '..') then 4 + length(s) % 3 end as depth from lines),
w as (select *, (sum((depth is not null or line = 1)::int) over o)::bigint as block, last_value(case when depth = 4 then line end ignore nulls) over o as p4, last_value(case when depth = 5 then line end ignore nulls) over o as p5,
  last_value(case when depth = 6 then line end ignore nulls) over o as p6, last_value(case when depth = 4 then s end ignore nulls) over o as l4, last_value(case when depth = 5 then s end ignore nulls) over o as l5,
  last_value(case when depth = 6 then s end ignore nulls) over o as l6 from h window o as (partition by doc_id order by line rows unbounded preceding)),
b as (select doc_id, block, string_agg(text, '' order by line) as text, any_value(p4) as p4, any_value(p5) as p5, any_value(p6) as p6, any_value(l4) as h4, any_value(l5) as l5, any_value(l6) as l6 from w group by doc_id, block),
v as (select *, case when p5 > coalesce(p4, 0) then l5 end as h5, case when p6 > coalesce(p4, 0) and p6 > coalesce(case when p5 > coalesce(p4, 0) then p5 end, 0) then l6 end as h6 from b)"""

ORACLES = {
    "heading_blocks": f"with {_BLOCKS} select doc_id, block, h4, h5, h6, upper(h4) as control_id, sha256(text) as text_hash from v where regexp_replace(text, '\\s+', '', 'g') <> ''",
    "line_furniture": f"with {_RUNNING} select source, signature from running",
    "strip_furniture": f"""with {_RUNNING}, r as (select source, list(signature) as s from running group by 1)
select d.source, doc_id, sha256(list_aggregate(list_filter({_LINES}, lambda x: not coalesce(list_contains(r.s, {_SIG.format('x')}), false)), 'string_agg', chr(10))) as text_hash from documents d left join r on d.source is not distinct from r.source""",
    "line_signatures": f"select doc_id, len({_LINES})::bigint as n_lines, len(list_distinct(list_transform({_LINES}, lambda x: {_SIG.format('x')})))::bigint as n_signatures from documents",
    "normalized_text": f"""select doc_id, sha256({_TRIM.format("regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '[ \\t]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) as text_hash, sha256(text) as content_hash,
case when length(t) > 60 then rtrim(substr(t, 1, 57)) || '...' else t end as title from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)""",
}
