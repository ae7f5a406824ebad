import zlib
from collections import Counter, defaultdict

from kashf.llm.kd_shards import kd_shards

from .cases import documents, got, prose, rows, table


def test_columns_and_slots(spark):
    out = kd_shards(documents(spark), 5).collect()
    want = table((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert table((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 5 for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_and_copies_together(spark):
    data = [(i, prose(i % 2900, 5 + i % 37), ("en", "de", "fr")[i % 3], f"s{min(i % 30, 9)}", 0) for i in range(4000)]
    out = kd_shards(documents(spark, data), 16).collect()
    sizes, where = Counter(), defaultdict(set)
    for r in out:
        sizes[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert all(len(s) == 1 for s in where.values())


def test_a_group_larger_than_a_shard_is_cut_by_row(spark):
    data = [(i, "the same text" if i % 3 else prose(i, 8), "en", "s", 0) for i in range(3000)]
    out = kd_shards(documents(spark, data), 8).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean


def test_empty_table_and_one_row(spark):
    assert kd_shards(documents(spark, [])).count() == 0
    assert len(got(kd_shards(documents(spark, [(1, None, None, None, None)])), "doc_id", "shard", "slot")) == 1
