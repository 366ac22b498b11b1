"""Cells of notebooks: JSON notebooks, and SQL or Python files that were exported from notebooks with marks between cells.

Each reader takes files (source_file, content) and gives source_file, cell (its number in the file; cells that are left out are counted),
language (sql or python) and source. Nothing but whole files is ever in one row, and nothing leaves Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of exported notebooks, and of cells in another language (fixed values).
SQL_HEADER, SQL_MARK = "-- Databricks notebook source", "-- COMMAND ----------"
PY_HEADER, PY_MARK, PY_MAGIC = "# Databricks", "# COMMAND ----------", "# MAGIC "
SQL_MAGICS = ("%sql", "%%sql", "%spark.sql")
_SPACE = " \t\n\r\x0b\x0c"
_CELLS = ["source_file", "cell", "language", "source"]


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """source_file (its whole path) and content of each file at or below path."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))


def json_cells(files: DataFrame) -> DataFrame:
    """Code cells of JSON notebooks. A file that is no JSON, or has no cells, has none; a cell's source may be a text or a list of lines.

    A cell is SQL if it begins with one of SQL_MAGICS (which is taken off) or says so in its metadata; other code is Python.
    """
    book = files.select("source_file", F.try_parse_json("content").alias("book"))
    each = book.select("source_file", F.posexplode(F.try_variant_get("book", "$.cells", "array<variant>")).alias("cell", "c"))
    lines, text = F.try_variant_get("c", "$.source", "array<string>"), F.try_variant_get("c", "$.source", "string")
    kind, language = F.try_variant_get("c", "$.cell_type", "string"), F.try_variant_get("c", "$.metadata.language", "string")
    each = each.select("source_file", "cell", kind.alias("kind"), language.alias("said"), F.coalesce(F.array_join(lines, ""), text).alias("source"))
    each = each.where((F.col("kind") == "code") & (_strip(F.col("source")) != ""))
    bare = _strip(F.col("source"))
    sql = F.when(F.col("said") == "sql", bare)
    for magic in reversed(SQL_MAGICS):
        sql = F.when(F.startswith(bare, F.lit(magic)), _strip(F.substring(bare, len(magic) + 1, 1 << 30))).otherwise(sql)
    each = each.withColumn("sql", sql)
    return each.select("source_file", "cell", F.when(F.col("sql").isNotNull(), "sql").otherwise("python").alias("language"), F.coalesce("sql", "source").alias("source"))


def _parts(files: DataFrame, mark: str) -> DataFrame:
    return files.select("source_file", F.posexplode(F.split("content", rf"\Q{mark}\E")).alias("cell", "part"))


def sql_cells(files: DataFrame) -> DataFrame:
    """Cells of SQL files; those of comments alone are left out."""
    bare = _strip(F.col("part"))
    body = F.when(F.startswith(bare, F.lit(SQL_HEADER)), _strip(F.substring(bare, len(SQL_HEADER) + 1, 1 << 30))).otherwise(bare)
    each = _parts(files, SQL_MARK).withColumn("source", body)
    says = F.exists(_lines(F.col("source")), lambda x: (_strip(x) != "") & ~F.startswith(_strip(x), F.lit("--")))
    return each.where(says).withColumn("language", F.lit("sql")).select(_CELLS)


def python_cells(files: DataFrame) -> DataFrame:
    """Cells of Python files. Lines after `# MAGIC ` are another language's: SQL after `%sql`; any other `%` ends what is taken."""
    each = _parts(files, PY_MARK).withColumn("lines", _lines(_strip(F.col("part"))))
    magic = F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(PY_MAGIC))), lambda x: F.substring(x, len(PY_MAGIC) + 1, 1 << 30))
    each = each.withColumn("magic", magic)
    is_sql = lambda x: F.startswith(x, F.lit("%sql"))
    other = F.transform("magic", lambda x: F.startswith(x, F.lit("%")) & ~is_sql(x))
    stop = F.coalesce(F.nullif(F.array_position(other, True), F.lit(0)) - 1, F.size("magic")).cast("int")
    each = each.withColumn("taken", F.slice("magic", 1, stop))
    said = F.filter(F.transform("taken", lambda x: F.when(is_sql(x), F.nullif(_strip(F.substring(x, 5, 1 << 30)), F.lit(""))).otherwise(x)), lambda x: x.isNotNull())
    sql = F.when(F.exists("taken", is_sql) & (F.size(said) > 0), F.array_join(said, "\n"))
    plain = _strip(F.array_join(F.filter("lines", lambda x: ~F.startswith(x, F.lit(PY_HEADER))), "\n"))
    source = F.when(F.size("magic") > 0, sql).otherwise(F.nullif(plain, F.lit("")))
    each = each.withColumn("source", source).withColumn("language", F.when(F.size("magic") > 0, "sql").otherwise("python"))
    return each.where("source is not null").select(_CELLS)
