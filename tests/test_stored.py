"""Stored tables: what a change rewrites and what it leaves, copies, loads, and a stream of refreshes."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_paths import EDGE

from millrace.sources import loads
from millrace.sources.stored import Conflict, StoredTable
from millrace.streaming import refresh


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 10).alias("cents"))
    return StoredTable(spark, f"file://{tmp_path}/t").create(rows.repartitionByRange(10, "id"))


def held(table, version=None):
    return {r["id"]: (r["name"], r["cents"]) for r in table.read(version).collect()}


def test_a_change_rewrites_only_the_files_it_touches(table):
    before = set(table.files())
    assert len(before) == 10
    old = table.update(F.col("id").between(33, 35), {"cents": -F.col("id"), "name": F.concat("name", F.lit("!"), F.col("cents").cast("string"))})
    after = set(table.files())
    assert before - after == set(old) and 1 <= len(old) <= 2
    assert held(table)[34] == ("n34!340", -34) and held(table)[36] == ("n36", 360) and held(table, 0)[34] == ("n34", 340)
    old = table.delete(F.col("id") >= 95)
    assert after - set(table.files()) == set(old) and len(old) == 1 and len(held(table)) == 95
    assert table.delete(F.col("id") > 1000) == [] and table.update(F.lit(None).cast("boolean"), {"cents": F.lit(1)}) == []
    assert table.version() == 2


def test_merge_leaves_files_without_its_keys(spark, table):
    before = set(table.files())
    source = spark.createDataFrame([(5, 1), (6, None), (200, 3), (None, 4), (None, 5)], "id long, n int")
    old = table.merge(source, "id", {"cents": F.col("cents") + F.col("s_n")}, {"id": F.col("s_id"), "cents": F.lit(1)}, F.col("s_n").isNull())
    assert len(old) == 1 and before - set(table.files()) == set(old)
    rows = held(table)
    assert rows[5] == ("n5", 51) and 6 not in rows and rows[200] == (None, 1) and rows[7] == ("n7", 70)
    assert table.read().where("id is null").count() == 2 and table.read().count() == 102
    insert_only = table.merge(spark.createDataFrame([(7, 1), (300, 1)], "id long, n int"), "id", insert={"id": F.col("s_id")})
    assert insert_only == [] and held(table)[7] == ("n7", 70) and 300 in held(table)
    with pytest.raises(ValueError, match="several source rows"):
        table.merge(spark.createDataFrame([(5, 1), (5, 2)], "id long, n int"), "id", {"cents": F.lit(0)})
    assert table.merge(source.limit(0), "id", {"cents": F.lit(0)}, {"id": F.col("s_id")}) == []


def test_of_two_writers_of_a_version_one_fails(spark, table):
    other = StoredTable(spark, table.folder)
    rows = spark.createDataFrame([(1000, "x", 1)], "id long, name string, cents long")
    files = other._write(rows)
    table.append(rows)
    with pytest.raises(Conflict):
        other._publish(files, 1)
    assert table.read().count() == 101


def test_clones_part_after_a_write(table, tmp_path):
    shallow, deep = table.shallow_clone(f"file://{tmp_path}/s"), table.deep_clone(f"file://{tmp_path}/d")
    assert shallow.files() and set(shallow.files()) == set(table.files()) and not set(deep.files()) & set(table.files())
    shallow.delete(F.col("id") < 5)
    table.update(F.col("id") == 99, {"cents": F.lit(0)})
    assert len(set(shallow.files()) & set(table.files())) == 8
    assert len(held(shallow)) == 95 and held(shallow)[99] == ("n99", 990)
    assert held(table)[99] == ("n99", 0) and len(held(table)) == 100 and held(deep) == held(table, 0)
    assert table.shallow_clone(f"file://{tmp_path}/old", 0).read().where("cents = 0 and id = 99").count() == 0


def test_an_empty_table_and_odd_names(spark, tmp_path):
    empty = StoredTable(spark, f"file://{tmp_path}/e").create(spark.createDataFrame([], "`a b` long, `c-d` array<string>"))
    assert empty.read().count() == 0 and empty.read().columns == ["a b", "c-d"]
    empty.append(spark.createDataFrame([(1, ["x"])], "`a b` long, `c-d` array<string>"))
    assert [tuple(r) for r in empty.read().collect()] == [(1, ["x"])]


def test_files_are_loaded_once(spark, tmp_path):
    files, folder = f"{tmp_path}/in", f"file://{tmp_path}/out"
    os.makedirs(f"{files}/deep")

    def put(name, *rows):
        with open(f"{files}/{name}", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))

    put("a.json", {"x": 1}, {"x": 2})
    put("deep/b b.json", {"x": 3})
    assert loads.copy_into(spark, folder, f"file://{files}", "json", "x int") == 2
    assert loads.copy_into(spark, folder, f"file://{files}", "json", "x int") == 0
    put("c.json", {"x": 4}, "no row of numbers")
    time.sleep(0.01)
    put("a.json", {"x": 1}, {"x": 2}, {"x": 5})  # written anew: another length
    assert loads.copy_into(spark, folder, f"file://{files}", "json", "x int") == 2
    os.makedirs(f"{tmp_path}/out/data/load=broken")
    spark.createDataFrame([(9, "lost.json")], "x int, source_file string").write.mode("append").parquet(f"{folder}/data/load=broken")
    rows = sorted(((r["x"], r["source_file"]) for r in loads.loaded(spark, folder, "x int").where("x is not null").collect()))
    assert [x for x, _ in rows] == [1, 1, 2, 2, 3, 4, 5] and {f.replace("%20", " ") for _, f in rows} == {"a.json", "b b.json", "c.json"}


def test_names_of_file_sources(spark):
    paths = spark.createDataFrame([("/mnt/raw/2024-01/",), ("s3://b/x y.csv",), ("",)], "p string")
    assert [r[0] for r in paths.select(loads.source_name(F.col("p"))).collect()] == ["mnt_raw_2024_01", "s3___b_x_y_csv", ""]


STORED = EDGE + ", source_id string, generation int"


def _batch(spark, *rows):
    full = [(None if s is None else f"{s}.x", f"t.{n}", "cast", "f.sql", None, 1, "certain", n, source, g) for n, (s, source, g) in enumerate(rows)]
    return spark.createDataFrame(full, STORED)


def _state(spark, folder, like):
    return sorted((r["source_col"], r["source_id"], r["generation"]) for r in refresh.read_graph(spark, folder, like).collect())


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_refreshes_replace_their_own_partitions_only(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    first = _batch(spark, ("a", "one", 1), ("b", "one", 1), ("c", "two", 1), ("d", "007", 1), ("e", "odd/name %", 1), (None, "none", 1), ("z", None, 1))
    assert refresh.apply(first, folder) == ["007", "none", "odd/name %", "one", "two"]
    assert _state(spark, folder, first) == [("a.x", "one", 1), ("b.x", "one", 1), ("c.x", "two", 1), ("d.x", "007", 1), ("e.x", "odd/name %", 1)]
    files = _files(f"{tmp_path}/g")
    second = _batch(spark, ("n", "one", 3), ("m", "one", 2), (None, "two", 2))
    for _ in range(2):
        refresh.apply(second, folder)
        assert _state(spark, folder, first) == [("d.x", "007", 1), ("e.x", "odd/name %", 1), ("n.x", "one", 3)]
    kept = {f: t for f, t in files.items() if "007" in f or "odd" in f}
    assert kept and kept.items() <= _files(f"{tmp_path}/g").items()
    assert refresh.apply(_batch(spark, ("late", "one", 2)), folder) == []
    assert ("n.x", "one", 3) in _state(spark, folder, first)
    refresh.apply(_batch(spark, (None, "odd/name %", 9), ("back", "two", 3)), folder)
    assert _state(spark, folder, first) == [("back.x", "two", 3), ("d.x", "007", 1), ("n.x", "one", 3)]
    assert refresh.apply(_batch(spark, ("again", "odd/name %", 8)), folder) == []
    refresh.apply(first.limit(0), folder)
    assert len(_state(spark, folder, first)) == 3


def test_a_stream_applies_each_arrival_once_and_goes_on_where_it_stopped(spark, tmp_path):
    arrivals, folder, checkpoint = (f"file://{tmp_path}/{x}" for x in ("arrivals", "graph", "stream"))
    like = _batch(spark)
    for rows in ([("a", "one", 1), ("b", "two", 1)], [("c", "one", 2)], [("d", "two", 2), ("e", "two", 2)]):
        _batch(spark, *rows).coalesce(1).write.mode("append").parquet(arrivals)
        refresh.follow(spark, arrivals, like.schema, folder, checkpoint, files_at_once=1)
        files = _files(f"{tmp_path}/graph")
        refresh.follow(spark, arrivals, like.schema, folder, checkpoint)
        assert _files(f"{tmp_path}/graph") == files
    assert _state(spark, folder, like) == [("c.x", "one", 2), ("d.x", "two", 2), ("e.x", "two", 2)]


def test_a_large_source_is_written_in_as_many_parts_as_its_rows_take(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "ROWS", 1000, raising=False)
    batch = spark.range(40_000).selectExpr("concat('a.', id) as source_col", "'b.x' as target_col", "'big' as source_id", "1 as generation")
    folder = f"file://{tmp_path}/graph"
    assert refresh.apply(batch.unionByName(batch.limit(10).withColumn("source_id", refresh.F.lit("small"))), folder) == ["big", "small"]
    stored = refresh.read_graph(spark, folder, batch)
    assert stored.count() == 40_010
    sizes = stored.where("source_id = 'big'").groupBy("_metadata.file_path").count().collect()
    assert len(sizes) > 16 and max(r["count"] for r in sizes) < 8000  # some parts share a task
