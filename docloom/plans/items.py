"""Documents as numbered items with a name and a group, for queries of functions that work row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.io import table

#: The same rows as a table expression of SQL; it stands in the place of the fixed table of that name.
SQL = "nation as (select doc_id::int as n_nationkey, 'NATION_' || doc_id as n_name, (doc_id % 5)::int as n_regionkey from documents)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("cast(doc_id as int) as n_nationkey", "'NATION_' || doc_id as n_name", "cast(doc_id % 5 as int) as n_regionkey")


def over_items(sql: str) -> str:
    return f"with {SQL}, {sql[5:]}" if sql.startswith("with ") else f"with {SQL} {sql}"
