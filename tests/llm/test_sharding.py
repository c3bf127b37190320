import random
import zlib

from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import sharding
from tidewatch.llm.store import new_folder


def check(rows, found, shards):
    """Everything of the contract but evenness; returns bytes by shard."""
    expected = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=str) == expected
    sums = [0] * shards
    for s in range(shards):
        own = [r for r in found if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sums[s] = sum(r["size"] for r in own)
    assert {r.shard for r in found} <= set(range(shards))
    return sums


def test_odd_rows(odd):
    check([r[:2] for r in ODD], sharding.assign_shards(clashing(odd), 8).collect(), 8)


def test_even_bytes_whole_groups_and_a_hot_group(documents):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randrange(5, 60))) for i in range(3000)]
    rows += [(10_000 + i, "the same text, many times over") for i in range(9000)]  # a third of the bytes
    rows += [(50_000 + i, f"pair {i // 2}") for i in range(400)]
    sums = check(rows, found := sharding.assign_shards(documents(rows), 8).collect(), 8)
    most = max(len(t) for _, t in rows) + 1
    assert max(sums) - min(sums) <= 2 * most + 2 * sharding.WHOLE * sum(sums) / 8
    homes = {}
    for r in found:
        if r.doc_id >= 50_000:
            homes.setdefault((r.doc_id - 50_000) // 2, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) == 0


def test_same_on_any_partitioning(documents):
    rows = [(i, prose(i, 30)) for i in range(500)]
    assert as_set(sharding.assign_shards(documents(rows, 1), 5), "*") == as_set(sharding.assign_shards(documents(rows, 9), 5), "*")


def test_overfull_ranges_are_subdivided(spark, documents):
    rows = [(i, "x" * (1 + (i % 1000 == 0) * 20_000)) for i in range(5000)]
    keyed = sharding._keyed(documents(rows), "doc_id", "text")
    splitters, sums = sharding.find_splitters(keyed, 64)
    total = sum(s for s, _ in sums.values())
    assert sum(n for _, n in sums.values()) == 5000
    assert all(s <= sharding.OVERFULL * total / 64 or n == 1 for s, n in sums.values())


def test_written_shards(spark, stored):
    folder = sharding.write_shards(stored, 4, new_folder(spark, "test-shards"))
    back = spark.read.parquet(folder)
    assert back.count() == stored.count() and set(stored.columns) <= set(back.columns)


def test_empty_table(empty):
    assert sharding.assign_shards(empty, 8).count() == 0
