import itertools
import random

import numpy as np
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import decontaminate


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def pairs(docs, items):
    return {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}


def test_passages_with_replaced_words(spark, documents):
    items = [prose(500 + i, 30 + i).replace("\n", " ") for i in range(10)] + ["seven words that stand in one line"]
    rng, rows, expected = random.Random(1), [], set()
    for i in range(200):
        text = prose(i, 100)
        if i % 4 == 0:
            k = rng.randrange(len(items))
            words = items[k].split()
            if k < 10:
                for at in range(4 + rng.randrange(5), len(words), 9):
                    words[at] = f"other{at}"
            text = text + " " + rng.choice([" ", "\n", " -- "]).join(words).upper() + " " + prose(900 + i, 20)
            expected.add((i, k))
        rows.append((i, text))
    assert pairs(documents(rows), items_of(spark, items)) == expected


def test_stretch_and_position(spark, documents):
    item = " ".join(f"w{i}" for i in range(20))
    found = decontaminate.overlaps(documents([(1, f"a b c {item} d")]), items_of(spark, [item])).first()
    assert tuple(found) == (1, 0, 3, 20, 20, 20)


def test_short_overlaps_do_not_count(spark, documents):
    item = " ".join(f"w{i}" for i in range(30))
    twelve, thirteen = " ".join(f"w{i}" for i in range(5, 17)), " ".join(f"w{i}" for i in range(5, 18))
    rows = [(1, f"x y {twelve} z"), (2, f"x y {thirteen} z"), (3, "w1 w2 w3 w4")]
    assert pairs(documents(rows), items_of(spark, [item, "w1 w2 w3 w4", None, ""])) == {(2, 0)}


def test_odd_rows(spark, odd):
    items = items_of(spark, [prose(6, 80), "no text has these words in it at all", None, ""])
    expected = sorted({(d, 0) for d, t, *_ in ODD if t == prose(6, 80)}, key=str)
    table = clashing(odd)
    assert sorted(pairs(table, items), key=str) == expected
    kept = decontaminate.without_overlaps(table, items)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in ODD if d not in {e[0] for e in expected})


def test_without_broadcast(spark, documents, monkeypatch):
    rows = [(i, prose(i % 7, 60)) for i in range(40)]
    items = items_of(spark, [prose(3, 60), prose(100, 60)])
    near = pairs(documents(rows), items)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert pairs(documents(rows), items) == near == {(i, 0) for i in range(40) if i % 7 == 3}


def test_stored_documents_hold_what_their_words_say(spark, stored):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = decontaminate.LOWER
    assert len(plain) == 256
    import re

    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    bench = {r.item_id: words(r.text) for r in items.collect()}
    grams = {}
    for i, w in bench.items():
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k: k + 13]), set()).add(i)
    expected = {(r.doc_id, i) for r in stored.collect() for w in [words(r.text)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k: k + 13]), ())}
    assert expected <= pairs(stored, items)


def test_empty_tables(spark, empty, odd):
    none = items_of(spark, ["a"]).where("false")
    assert decontaminate.overlaps(empty, items_of(spark, [prose(1, 30)])).count() == 0
    assert decontaminate.overlaps(odd, none).count() == 0
    assert as_set(decontaminate.without_overlaps(odd, none), "doc_id") == as_set(odd, "doc_id")


def test_every_placement_of_replaced_words(spark, documents):
    """Against all stretches of the diagonal; no two items share a word."""
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in range(15, 21)]
    rows, expected = [], set()
    for k, item in enumerate(items):
        words = item.split()
        for m in (1, 2, 3, 4) if len(words) == 20 else (1, 2, 3):
            for places in itertools.combinations(range(len(words)), m):
                d = len(rows)
                rows.append((d, " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))))
                same = [i not in places for i in range(len(words))]
                if any(sum(same[a:b]) >= 13 and sum(same[a:b]) >= 0.8 * (b - a) for a in range(len(same)) for b in range(a + 13, len(same) + 1)):
                    expected.add((d, k))
    found = pairs(documents(rows), items_of(spark, items))
    assert len(expected) > 9000 and found == expected


def test_masks_miss_no_stretch_that_counts():
    """All shortest stretches: 13 equal words of up to 16, or exactly four in five up to 30 words."""
    for n, m in ((13, 0), (14, 1), (15, 2), (16, 3), (20, 4), (25, 5), (30, 6)):
        same = np.full(1, (1 << n) - 1)
        if m:  # the first and the last word are equal; others hold a shorter one
            same = same - (1 << np.array(list(itertools.combinations(range(1, n - 1), m)))).sum(axis=1)
        hit = np.zeros(len(same), bool)
        for mask in decontaminate.MASKS:
            for at in range(n - len(mask) + 1):
                wanted = int(mask, 2) << at
                hit |= same & wanted == wanted
        assert hit.all()


def test_neighbouring_copies_of_a_short_item(spark, documents):
    item = "six words that stand in line"
    rows = [(i, item) for i in range(40)]
    assert pairs(documents(rows, partitions=1), items_of(spark, [item])) == {(i, 0) for i in range(40)}


def test_a_full_bitmap_costs_no_hit(spark, documents, monkeypatch):
    """As with a benchmark so large that every place of a document hits the bitmap."""
    items = [" ".join(f"i{k}w{j}" for j in range(16)) for k in range(6)] + ["seven words that stand in one line"]
    rows = []
    for d in range(60):
        words = [w if j not in (3, 7, 11) else f"x{d}" for j, w in enumerate(items[d % 7].split())] if d % 7 < 6 else items[6].split()
        rows.append((d, f"{prose(d, d % 13)} {' '.join(words)} {prose(100 + d, 30)}"))
    expected = {(d, d % 7) for d in range(60)}
    assert pairs(documents(rows), items_of(spark, items)) == expected
    monkeypatch.setattr(decontaminate, "bitmap", lambda windows: np.full(1 << 10, 2**64 - 1, np.uint64))
    assert pairs(documents(rows), items_of(spark, items)) == expected
