"""Shards against a sort and running sums in Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import sharding

KIND = "doc_id long, text string, shard string, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "theirs", 1) for i, t in rows], KIND)


def expected(rows, shards):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    sizes = [len((t or "").encode()) + 1 for _, t in order]
    total, run, out, slots = sum(sizes), 0, [], Counter()
    for (i, t), size in zip(order, sizes):
        shard = (2 * run + size) * shards // (2 * total)
        out.append((i, t, size, shard, slots[shard]))
        slots[shard] += 1
        run += size
    return out


def data():
    rng = random.Random(5)
    rows = [(i, "é日x "[i % 4] * rng.randrange(200)) for i in rng.sample(range(5000), 300)]
    rows += [(9001, "copy of a row " * 9)] * 400 + [(9002, "same text")] + [(9003, "same text")]
    return rows + [(None, None), (None, ""), (None, "text"), (-5, "first"), (77, "twice"), (77, "twice too")]


@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_shards_are_those_of_one_sorted_list(spark, shards):
    rows = data()
    out = sharding.sharded(table(spark, rows), shards)
    assert out.columns == ["doc_id", "text", "row", "shard", "slot", "shard_size"]
    got = sorted(((r.doc_id, r.text or "", r.shard_size, r.shard, r.slot) for r in out.collect()), key=repr)
    assert got == sorted(((i, t or "", *more) for i, t, *more in expected(rows, shards)), key=repr)


def test_sizes_differ_by_no_more_than_documents(spark):
    rows = data()
    found = sharding.sharded(table(spark, rows)).collect()
    held, largest = Counter(), max(r.shard_size for r in found)
    for r in found:
        held[r.shard] += r.shard_size
    share = sum(held.values()) / 8
    assert len(held) == 8 and all(abs(x - share) <= largest for x in held.values())
    assert len({r.shard for r in found if r.doc_id == 9001}) > 1  # copies of one row are cut as well


def test_a_very_long_text_leaves_shards_empty(spark):
    rows = [(i, "x") for i in range(10)] + [(5, "long " * 400_000)]
    found = {(r.doc_id, r.shard_size): r.shard for r in sharding.sharded(table(spark, rows), 4).collect()}
    assert found[(5, 2_000_001)] == 2 and {s for (i, n), s in found.items() if i < 5} == {0} and {s for (i, n), s in found.items() if i > 5} == {3}


def test_empty_table_and_no_shards(spark):
    assert sharding.sharded(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.sharded(table(spark, []), 0)


def test_written_shards_are_read_back(spark, tmp_path):
    rows = data()
    sharding.write_shards(table(spark, rows), f"{tmp_path}/shards", 5)
    back = defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/shards").collect():
        back[r.shard].append(r)
    assert sorted(back) == [0, 1, 2, 3, 4]
    for found in back.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    assert sorted(((r.doc_id, r.text or "") for f in back.values() for r in f), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_only_sizes_follow_the_sort(spark):
    docs = table(spark, data())
    ordered = sharding._ordered(docs)
    plan = sharding._cuts(ordered, 8)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "Python" not in plan and "InPandas" not in plan


def test_query(spark, tmp_path):
    rows = data()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op12_sharding(spark, str(tmp_path))
    assert dict(out.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, n, zlib.crc32((t or "").encode()), "bytes", s, at, None) for i, t, n, s, at in expected(rows, 8)), key=repr)
