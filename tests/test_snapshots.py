"""Index snapshots: rewrites, crashes, concurrent writers, expiry."""

import pytest
from pyspark.sql import functions as F

from veracity.operators.index import SnapshotTable, read_index, write_index, write_shards
from veracity.sources import snapshots as SN


def vectors(spark, rows):
    return spark.createDataFrame([(i, c, [float(i)]) for i, c in rows], "title_id bigint, cell int, embedding array<float>")


def held(df):
    return sorted((r.title_id, r.cell, r.embedding[0]) for r in df.collect())


def test_rewritten_shard_loses_old_cells(spark, tmp_path):
    path = str(tmp_path / "idx")
    assert write_index(vectors(spark, [(1, 0), (2, 1)]), path, 0) == 1
    assert write_index(vectors(spark, [(600, 1)]), path, 1) == 2
    assert write_index(vectors(spark, [(1, 0)]), path, 0) == 3
    assert held(read_index(spark, path)) == [(1, 0, 1.0), (600, 1, 600.0)]
    # older snapshots read as they were
    assert held(read_index(spark, path, 2)) == [(1, 0, 1.0), (2, 1, 2.0), (600, 1, 600.0)]
    assert held(read_index(spark, path, 1)) == [(1, 0, 1.0), (2, 1, 2.0)]
    # a shard may become empty
    write_index(vectors(spark, []), path, 1)
    assert held(read_index(spark, path)) == [(1, 0, 1.0)]


def test_failed_write_leaves_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "idx")
    write_index(vectors(spark, [(i, i % 3) for i in range(30)]), path, 0)
    bad = vectors(spark, [(i, i % 3) for i in range(30)]).withColumn(
        "embedding", F.when(F.col("title_id") == 29, F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="lost"):
        write_index(bad, path, 0)
    assert SnapshotTable(spark, path).numbers() == [1]
    assert len(held(read_index(spark, path))) == 30


def test_crash_between_data_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "idx")
    write_index(vectors(spark, [(1, 0)]), path, 0)
    monkeypatch.setattr(SnapshotTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver died")))
    with pytest.raises(RuntimeError):
        write_index(vectors(spark, [(2, 0)]), path, 0)
    monkeypatch.undo()
    assert held(read_index(spark, path)) == [(1, 0, 1.0)]
    # the data nobody names goes with the next expiry, once it is old enough
    table = SnapshotTable(spark, path)
    assert table.expire(min_age_s=3600) == 0 and table.expire(min_age_s=-60) == 1
    assert held(read_index(spark, path)) == [(1, 0, 1.0)]


def test_second_of_two_writers_takes_the_first_ones_parts_over(spark, tmp_path):
    path = str(tmp_path / "idx")
    write_index(vectors(spark, [(1, 0)]), path, 0)
    table = SnapshotTable(spark, path)
    seen = table.snapshot()  # what a slow writer of shard 2 starts from
    write_index(vectors(spark, [(600, 0)]), path, 1)
    folder = table.new_folder() + "/shard=2"
    vectors(spark, [(1200, 0)]).select("title_id", "embedding", "cell").write.partitionBy("cell").parquet(table.uri(folder))
    made = table.commit({"2": folder}, seen.schema, base=seen)
    assert made.number == 3 and sorted(made.parts) == ["0", "1", "2"]
    assert [t for t, _, _ in held(read_index(spark, path))] == [1, 600, 1200]
    # the file of a snapshot is never replaced
    with pytest.raises(FileExistsError):
        table._create(table._name(3), b"{}")
    assert not [f for f in table._list(SN._MANIFESTS) if f.getPath().getName().endswith(".tmp")]


def test_whole_build_and_expiry(spark, tmp_path):
    path = str(tmp_path / "idx")
    write_shards(vectors(spark, [(i, i % 4) for i in range(100)]), path, capacity=10, cell_rows=2)
    table = SnapshotTable(spark, path)
    assert sorted(map(int, table.snapshot().parts)) == list(range(10))
    write_shards(vectors(spark, [(i, 0) for i in range(25)]), path, capacity=10)
    write_index(vectors(spark, [(5, 1)]), path, 0)
    assert [t for t, _, _ in held(read_index(spark, path))] == [5, *range(10, 25)]
    # shards 1 and 2 still stand in the second build's folder, the first build is unused
    assert table.expire(keep=1, min_age_s=-60) == 1 and table.numbers() == [3]
    assert [t for t, _, _ in held(read_index(spark, path))] == [5, *range(10, 25)]
    with pytest.raises(ValueError):
        table.expire(keep=0)


def test_cells_prune_folders(spark, tmp_path):
    path = str(tmp_path / "idx")
    write_index(vectors(spark, [(i, i % 5) for i in range(50)]), path, 0)
    plan = read_index(spark, path).where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    assert read_index(spark, path).where("cell = 3").count() == 10


def test_lost_data_and_other_columns_are_errors(spark, tmp_path):
    path = str(tmp_path / "idx")
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)
    write_index(vectors(spark, [(1, 0), (2, 1)]), path, 0)
    wide = vectors(spark, [(1, 0)]).withColumn("embedding", F.col("embedding").cast("array<double>"))
    with pytest.raises(ValueError):
        write_index(wide, path, 1)
    folder = tmp_path / "idx" / SnapshotTable(spark, path).snapshot().parts["0"] / "cell=1"
    for f in folder.iterdir():
        f.unlink()
    with pytest.raises(FileNotFoundError):
        read_index(spark, path)
