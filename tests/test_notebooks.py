"""Cell rules, each on a small file."""

import json

from millrace.sources import notebooks


def cells(spark, reader, *contents):
    files = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "source_file string, content string")
    return sorted((r["source_file"], r["cell"], r["language"], r["source"]) for r in reader(files).collect())


def test_sql_files_count_the_cells_they_leave_out(spark):
    text = "-- Databricks notebook source\n-- COMMAND ----------\nSELECT a FROM t1\n-- COMMAND ----------\n-- just a comment\n-- COMMAND ----------\n\n-- first\n SELECT b FROM t2 \n"
    assert cells(spark, notebooks.sql_cells, text) == [("f0", 1, "sql", "SELECT a FROM t1"), ("f0", 3, "sql", "-- first\n SELECT b FROM t2")]
    notes = "-- Databricks notebook source\n-- COMMAND ----------\n-- This is a comment-only cell\n-- Another comment\n-- COMMAND ----------\nSELECT x FROM src\n"
    assert cells(spark, notebooks.sql_cells, notes) == [("f0", 2, "sql", "SELECT x FROM src")]
    assert cells(spark, notebooks.sql_cells, "-- Databricks notebook source\nSELECT 1", "SELECT 2", "", None) == [("f0", 0, "sql", "SELECT 1"), ("f1", 0, "sql", "SELECT 2")]


def test_python_files_with_magics(spark):
    text = "\n# COMMAND ----------\n".join([
        "# Databricks notebook source", "x = 1\n\ny = 2", "# MAGIC %sql\n# MAGIC SELECT a\n# MAGIC FROM t", "# MAGIC %md\n# MAGIC words", "# MAGIC %sql SELECT b\n# MAGIC %python\n# MAGIC z()",
        "# Databricks\nafter = 3", "  \n", "# MAGIC SELECT c", "# MAGIC %sql\n# MAGIC %md", "w = 1\n# MAGIC %sql SELECT d",
    ])
    want = [(1, "python", "x = 1\n\ny = 2"), (2, "sql", "SELECT a\nFROM t"), (4, "sql", "SELECT b"), (5, "python", "after = 3"), (9, "sql", "SELECT d")]
    assert cells(spark, notebooks.python_cells, text) == [("f0", *w) for w in want]
    assert cells(spark, notebooks.python_cells, "", None) == []


def test_json_notebooks(spark):
    code = lambda source, **meta: {"cell_type": "code", "metadata": meta, "source": source}
    book = {"cells": [
        {"cell_type": "markdown", "metadata": {}, "source": "SELECT no"}, code("  %%sql select 1 "), code(["a = 1\n", "b = 2"]), code("select 2", language="sql"), code(" \n"), code("%spark.sql\nselect 3"),
        code("[1, 2]"), {"cell_type": "code", "source": "no = 'metadata'"}, {"cell_type": "code", "metadata": None}, code(["%sql\n", "select 4"], language="python"), code([]), code("é \"quoted\" \\ \t"),
    ]}
    want = [(1, "sql", "select 1"), (2, "python", "a = 1\nb = 2"), (3, "sql", "select 2"), (5, "sql", "select 3"), (6, "python", "[1, 2]"), (7, "python", "no = 'metadata'"), (9, "sql", "select 4"), (11, "python", "é \"quoted\" \\ \t")]
    whole = json.dumps(book)
    bad = [whole[: len(whole) // 2], "", None, "[]", "{}", '{"cells": 5}', '{"cells": [1, null, {}]}', "not json"]
    assert cells(spark, notebooks.json_cells, whole, *bad) == [("f0", *w) for w in want]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a b.sql").write_text("SELECT 1\r\n-- COMMAND ----------\nSELECT 2")
    (tmp_path / "x.txt").write_text("SELECT 3")
    files = notebooks.read_files(spark, f"file://{tmp_path}", "*.sql")
    assert [(r["cell"], r["source"]) for r in notebooks.sql_cells(files).collect()] == [(0, "SELECT 1"), (1, "SELECT 2")]
