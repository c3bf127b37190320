import random
import re

import numpy as np
import xxhash
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import simhash
from tidewatch.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known, default=None)
    return sorted(((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=lambda r: [(v is not None, str(v)) for v in r])


def test_odd_rows(odd):
    assert as_set(simhash.near_duplicates(clashing(odd)), "doc_id", "fingerprint", "component_id") == brute([r[:2] for r in ODD])


def test_stored_documents(stored):
    assert as_set(simhash.near_duplicates(stored), "*") == brute([(r.doc_id, r.text) for r in stored.collect()])


def test_near_copies_in_one_group(documents):
    base, rng, rows = prose(1, 400), random.Random(1), []
    for i in range(60):
        words = base.split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    assert as_set(simhash.near_duplicates(documents(rows)), "*") == brute(rows)
    kept = simhash.keep_one(documents(rows + rows[:5]))
    assert kept.count() == len({c for *_, c in brute(rows)})


def test_pairs_are_all_pairs_within_distance(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(4)}
        prints |= {p ^ sum(1 << rng.randrange(64) for _ in range(3)) & (2**64 - 1)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    for bits in (1, 2, 3, 5):
        found = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
        expected = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert found == expected


def test_keep_one_keeps_columns_and_first(odd):
    kept = simhash.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns
    groups = {}
    for d, _, c in brute([r[:2] for r in ODD]):
        groups.setdefault(c, []).append(d)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, groups))


def test_rows_made_by_an_explode_are_not_sent_to_every_task(spark):
    """Spark takes some 70 rows for each fingerprint for one or two, so it must not choose by their size."""
    pairs = simhash.near_pairs(spark.range(9).withColumnRenamed("id", "fp"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for b in range(9) for a in range(b) if (a ^ b).bit_count() <= 2}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, None), (9000, 9001), (9001, 9000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 9000: 9000, 9001: 9000}
