import os

import numpy as np

from plumbline.llm import sharding
from tests.llm.rows import documents, none


def jump_by_hand(key: int, shards: int) -> int:
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * sharding.FACTOR + 1) % (1 << 64)
        ahead = int((at + 1) * (sharding.SPAN / ((key >> 33) + 1)))
    return at


def test_buckets_match_the_scalar_rule():
    keys = np.concatenate([np.arange(200), np.random.default_rng(0).integers(0, 1 << 60, 500)])
    for shards in (1, 2, 16, 17, 1000):
        got = sharding.jump_buckets(keys, shards)
        assert got.tolist() == [jump_by_hand(int(k), shards) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 50_000)
    before, after = sharding.jump_buckets(keys, 16), sharding.jump_buckets(keys, 17)
    moved = before != after
    assert (after[moved] == 16).all()
    assert abs(moved.mean() - 1 / 17) < 0.01
    assert np.bincount(before).min() > 0.9 * len(keys) / 16


def test_rows_stay_and_slots_have_no_gaps(spark):
    df = sharding.with_shards(documents(spark), "doc_id", 4)
    assert df.count() == 15 and df.columns == documents(spark).columns
    rows = sharding.with_slots(df, "shard", rows_per_cell=2).collect()
    assert len(rows) == 15
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_a_row_repeated_very_often(spark):
    df = spark.range(5000).selectExpr("1L as k", "'same' as v").union(spark.range(10).selectExpr("id as k", "'other' as v"))
    rows = sharding.with_slots(sharding.with_shards(df, "k", 1), "shard", rows_per_cell=100).collect()
    assert sorted(r["slot"] for r in rows) == list(range(5010))


def test_empty_table_and_bad_numbers(spark):
    assert sharding.with_slots(sharding.with_shards(none(spark), "doc_id", 4), "shard").count() == 0
    for bad in (0, -1):
        try:
            sharding.with_shards(none(spark), "doc_id", bad)
        except ValueError:
            continue
        raise AssertionError("no error")


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    df = documents(spark)
    sharding.write_shards(df, path, "doc_id", 4, files_per_shard=2)
    back = spark.read.parquet(path)
    assert back.count() == 15
    assert set(os.listdir(path)) - {"_SUCCESS", "._SUCCESS.crc"} <= {f"shard={n}" for n in range(4)}
