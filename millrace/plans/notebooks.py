"""Cells of notebooks that are written from conversations and documents, and the SQL that says the same of these tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import notebooks
from millrace.sources.shared import alone, fresh

Query = Callable[[SparkSession, str], DataFrame]


def _written(spark: SparkSession, rows: DataFrame, content: Column) -> DataFrame:
    """content of each file's rows (column `book`), written as one file for each book and read back; source_file is the book's number."""
    folder = fresh(spark, "books")
    made = rows.groupBy("book").agg(content.alias("content"))
    made.write.partitionBy("book").option("lineSep", "\n").text(folder)
    files = notebooks.read_files(spark, folder)
    return files.withColumn("source_file", F.regexp_extract("source_file", "book=([0-9]+)", 1))


def json_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """twenty conversations are a notebook, whose code cells are what users say. Every fourth file is cut off in its middle."""

    def make() -> DataFrame:
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("book", F.expr("conv_id div 20"))
        prefix = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "%sql\n").when((F.col("conv_id") + F.col("turn")) % 5 == 0, " %%sql ").otherwise("")
        text = F.concat(prefix, F.coalesce("text", F.lit("")))
        kind = F.when(F.col("role") == "user", "code").otherwise("markdown")
        meta = F.when(F.col("turn") % 4 == 1, '{"language": "sql"}').otherwise("{}")
        lines = F.concat(F.lit("["), F.array_join(F.transform(F.split(text, "(?<=\n)"), lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)), ","), F.lit("]"))
        one = F.to_json(F.array(text))
        source = F.when(F.col("turn") % 2 == 0, lines).otherwise(one.substr(F.lit(2), F.length(one) - 2))
        cell = F.concat(F.lit('{"cell_type": "'), kind, F.lit('", "metadata": '), meta, F.lit(', "source": '), source, F.lit("}"))
        rows = turns.withColumn("c", F.struct("conv_id", "turn", "role", "text", cell.alias("cell")))
        whole = F.concat(F.lit('{"nbformat": 4, "cells": ['), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cell"]), ","), F.lit("]}"))
        content = F.when(F.col("book") % 4 == 3, whole.substr(F.lit(1), F.expr("1") + F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
        return notebooks.json_cells(_written(spark, rows, content))

    return alone(spark, make)


_JSON_BOOKS = r"""with t as (
  select conv_id // 20 as book, role, turn, row_number() over (partition by conv_id // 20 order by conv_id, turn, role, text) - 1 as cell,
    case when (conv_id + turn) % 3 = 0 then '%sql' || chr(10) when (conv_id + turn) % 5 = 0 then ' %%sql ' else '' end as magic, coalesce(text, '') as text from conversations
), s as (select *, ' ' || chr(9) || chr(10) || chr(13) as w from t)
select cast(book as varchar) as source_file, cast(cell as integer) as cell, case when magic <> '' then 'sql' else 'python' end as language, case when magic <> '' then trim(text, w) else text end as source
from s where role = 'user' and book % 4 <> 3 and trim(magic || text, w) <> '' and not (magic = '' and turn % 4 = 1)
union all select cast(book as varchar), cast(cell as integer), 'sql', trim(text, w) from s where role = 'user' and book % 4 <> 3 and trim(text, w) <> '' and magic = '' and turn % 4 = 1"""

_NOTE = "-- only a note"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("doc_id div 50").alias("book"))


def _joined(header: str, mark: str) -> Column:
    cells = F.transform(F.array_sort(F.collect_list("c")), lambda x: F.concat(F.lit(f"{mark}\n"), x["cell"], F.lit("\n")))
    return F.concat(F.lit(f"{header}\n"), F.array_join(cells, ""))


def sql_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fifty documents are an SQL file; every third cell is a comment, and every fifth has one before its text."""

    def make() -> DataFrame:
        cell = F.when(F.col("doc_id") % 3 == 0, F.lit(f"{_NOTE}\n\n  -- and another")).when(F.col("doc_id") % 5 == 0, F.concat(F.lit(f"{_NOTE}\n"), "text")).otherwise(F.col("text"))
        rows = _documents(spark, sf_dir).withColumn("c", F.struct("doc_id", cell.alias("cell")))
        return notebooks.sql_cells(_written(spark, rows, _joined(notebooks.SQL_HEADER, notebooks.SQL_MARK)))

    return alone(spark, make)


_NUMBERED = """d as (select doc_id, doc_id // 50 as book, row_number() over (partition by doc_id // 50 order by doc_id) as cell, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) as text from documents)"""
_SQL_BOOKS = f"""with {_NUMBERED}
select cast(book as varchar) as source_file, cast(cell as integer) as cell, 'sql' as language, case when doc_id % 5 = 0 then '{_NOTE}' || chr(10) || text else text end as source
from d where doc_id % 3 <> 0 and text <> ''"""


def python_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fifty documents are a Python file; by turns a cell is Python, SQL, SQL that another magic ends, or another magic's alone."""

    def make() -> DataFrame:
        magic = F.concat(F.lit("# MAGIC "), F.regexp_replace("text", "\r\n|\n|\r", "\n# MAGIC "))
        turn = F.col("doc_id") % 4
        cell = F.when(turn == 0, F.col("text")).when(turn == 1, F.concat(F.lit("# MAGIC %sql\n"), magic)).when(turn == 2, F.concat(F.lit("# MAGIC %sql select "), "doc_id", F.lit("\n# MAGIC %md\n"), magic)).otherwise(F.concat(F.lit("# MAGIC %md\n"), magic))
        rows = _documents(spark, sf_dir).withColumn("c", F.struct("doc_id", cell.alias("cell")))
        return notebooks.python_cells(_written(spark, rows, _joined("# Databricks notebook source", notebooks.PY_MARK)))

    return alone(spark, make)


_PYTHON_BOOKS = f"""with {_NUMBERED}
select cast(book as varchar) as source_file, cast(cell as integer) as cell, case when doc_id % 4 = 0 then 'python' else 'sql' end as language, case when doc_id % 4 = 2 then 'select ' || doc_id else text end as source
from d where doc_id % 4 = 2 or (doc_id % 4 < 2 and text <> '')"""

_QUERIES: dict[str, tuple[Query, str]] = {
    "f07_json_notebooks": (json_books, _JSON_BOOKS),
    "f04_sql_cells": (sql_books, _SQL_BOOKS),
    "f06_python_cells": (python_books, _PYTHON_BOOKS),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
