import pytest

from quillmill.llm.shards import ManifestConflict, ShardStore, ingest

SCHEMA = "doc_id long, text string, __shard string, version int"


def rows(n, start=0):
    return [(i, f"text {i} " * (i % 7), None if i % 3 else "x", i) for i in range(start, start + n)]


def small(spark, root, **options):
    return ShardStore(spark, str(root), **{"target_bytes": 40_000, "base_bytes": 1_000, "ratio": 4, "min_runs": 3} | options)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_compact_and_versions(spark, tmp_path):
    store = small(spark, tmp_path / "s")
    expected = []
    for k in range(7):
        part = rows(50, 50 * k) + rows(1, 50 * k)  # a repeated row
        expected += part
        assert store.append(spark.createDataFrame(part, SCHEMA).coalesce(2)) == k + 1
    before = store.manifest()["shards"]
    assert len(before) == 14
    version = store.compact()
    after = store.manifest()["shards"]
    assert version > 7 and len(after) < len(before)
    assert sum(s["rows"] for s in after) == len(expected)
    assert not store.plan(after)
    assert content(store.read()) == sorted(expected, key=repr)
    assert store.read(3).count() == 153  # an old version can still be read
    store.vacuum()
    assert content(store.read()) == sorted(expected, key=repr)


def test_large_files_are_left_alone(spark, tmp_path):
    store = small(spark, tmp_path / "s", target_bytes=2_000)
    store.append(spark.createDataFrame(rows(200), SCHEMA).repartition(4))
    assert all(s["bytes"] >= 1_500 for s in store.manifest()["shards"])
    assert store.compact() == 1


def test_plan_takes_the_lowest_due_tier(spark, tmp_path):
    store = small(spark, tmp_path / "s")
    shards = [{"file": str(i), "bytes": b} for i, b in enumerate([500, 900, 5_000, 5_100, 6_000, 39_000, 39_000, 39_000])]
    assert [s["file"] for s in store.plan(shards)] == ["2", "3", "4"]
    assert store.plan(shards[:2]) == []


def test_commit_is_exclusive(spark, tmp_path):
    store = small(spark, tmp_path / "s")
    df = spark.createDataFrame(rows(5), SCHEMA)
    store.append(df)
    with pytest.raises(ManifestConflict):
        store.commit(0, df.schema, [])
    assert store.version() == 1 and store.read().count() == 5
    with pytest.raises(ValueError):
        store.append(df.select("doc_id"))


def test_ingest_keeps_all_rows(spark, tmp_path):
    data = rows(300) + rows(20) + [(None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    store = ingest(df, str(tmp_path / "s"), target_bytes=40_000, base_bytes=1_000, min_runs=3)
    assert content(store.read()) == sorted(data, key=repr)
    with_shards = store.read_with_shards()
    assert with_shards.columns == ["doc_id", "text", "__shard", "version", "___shard", "__version"]
    got = [tuple(r) for r in with_shards.collect()]
    assert sorted((r[:4] for r in got), key=repr) == sorted(data, key=repr)
    assert {r[4] for r in got} == set(range(len(store.manifest()["shards"]))) and {r[5] for r in got} == {store.version()}
    empty = ingest(df.limit(0), str(tmp_path / "e"))
    assert empty.read().collect() == [] and empty.version() == 1


CLASHING = "doc_id long, Arrival string, __tail string, __Shard int, __version string, `a.b` string, _metadata string"


def test_any_column_name_is_kept(spark, tmp_path):
    data = [(i, f"a{i}", f"t{i}", i, f"v{i}", f"d{i}", f"m{i}") for i in range(40)]
    store = ingest(spark.createDataFrame(data, CLASHING), str(tmp_path / "s"), min_runs=2)
    assert content(store.read()) == sorted(data, key=repr)
    got = store.read_with_shards()
    assert got.columns[-2:] == ["___shard", "___version"]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == sorted(data, key=repr)


def test_held_versions_stay_readable(spark, tmp_path):
    data = rows(400)
    store = ingest(spark.createDataFrame(data, SCHEMA), str(tmp_path / "s"), target_bytes=40_000, base_bytes=1_000, min_runs=3, keep=2)
    now = store.version()
    assert content(store.read(now)) == content(spark.createDataFrame(data, SCHEMA))
    assert store.read(now - 1).count() == len(data)
    assert store.vacuum(1) > 0 and content(store.read()) == sorted(data, key=repr)
