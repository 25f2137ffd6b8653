"""Shards by byte prefix sums against plain Python."""

import zlib

import numpy as np
import pytest

from hindcast.llm import sharding


def brute(rows, shards):
    rows = sorted(((d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in rows)
    total, at, out, slots = sum(r[2] for r in rows), 0, [], {}
    for (known, d), crc, size in rows:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((d if known else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return out


@pytest.mark.parametrize("n", [1, 7, 400])
def test_against_plain_python(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, n)) if rng.random() > 0.05 else None, None if rng.random() < 0.1 else "é" * int(rng.integers(0, 200))) for _ in range(n)]
    rows += [rows[0]] * (n // 3)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").repartition(6)
    found = sharding.shard_by_bytes(docs, 8, partitions=5)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, 8), key=key)


def test_balance_and_empty(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 300)) for i in range(2000)], "doc_id long, text string")
    sizes = [r["sum(size)"] for r in sharding.shard_by_bytes(docs).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 316
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, "a" * 100_000), (2, "b"), (3, None)], "doc_id long, text string")
    assert {r.slot for r in sharding.shard_by_bytes(huge).collect()} <= {0, 1, 2}
