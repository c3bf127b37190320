import random
import re
from collections import Counter

import pytest
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_counts(rows):
    found, totals = Counter(), Counter()
    for row in rows:
        text, lang = row[1] or "", (row[2] if len(row) > 2 else "en")
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    found[lang, tuple(words[i: i + size])] += 1
    return found, totals


def plain(rows, least, top):
    found, totals = plain_counts(rows)
    candidates = {k: n for k, n in found.items() if len(k[1]) > 1 and n >= least}
    inside = {}
    for (lang, words), n in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, words[i: i + size])
                inside[key] = max(inside.get(key, 0), n)
    scored = {}
    for (lang, words), a in candidates.items():
        if 100 * inside.get((lang, words), 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, words[:k]], found[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, totals[lang], -s)
        for lang, all_of in scored.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:top], 1))


def corpus(n=40, seed=3):
    rng = random.Random(seed)
    idioms = ["once upon a time", "by and large", "New York City hall", "x y x y x y", "a  b\tc", "na na na na na na"]
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(40), 25)] + [rng.choice(idioms) + rng.choice(["", ".", ",", "\n", " "]) for _ in range(12)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "fr", None]), "s"))
    return rows


@pytest.mark.parametrize("shards", [1, 3])
def test_rows_match_plain_counting(documents, shards):
    rows = corpus() + [(100 + i, *r[1:]) if len(r) > 2 else (100 + i, r[1], "en", "s") for i, r in enumerate(ODD)]
    found = as_set(collocations.mine(clashing(documents(rows)), least=6, top=50, shards=shards), *COLUMNS)
    expected = plain(rows, 6, 50)
    assert len(expected) > 60 and {len(r[2].split(" ")) for r in expected} >= {2, 3, 4, 5}
    assert sorted(found) == expected


@pytest.mark.parametrize("bits", [3])
def test_shared_slots_lose_nothing(documents, monkeypatch, bits):
    monkeypatch.setattr(collocations, "SLOT_BITS", bits)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "BATCH_ROWS", 7)
    rows = corpus(30, 5)
    assert sorted(as_set(collocations.mine(documents(rows), least=4), *COLUMNS)) == plain(rows, 4, 2000)


def test_a_slot_reached_before_its_phrase(documents, monkeypatch):
    """Many frequent pairs of few words fill the slots of pairs, rare words come late: whole cycles all the same."""
    monkeypatch.setattr(collocations, "SLOT_BITS", 9)
    rng = random.Random(1)
    common = [f"c{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(120)), "en", "s") for i in range(90)]
    rows += [(100 + i, f"r{i} " * 30, "en", "s") for i in range(12)]
    expected = plain(rows, 20, 2000)
    assert sum(r[2].startswith("r") for r in expected) > 20
    assert sorted(as_set(collocations.mine(documents(rows), least=20), *COLUMNS)) == expected


def test_texts_cut_down_to_some_words():
    import numpy as np
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array(["Aé  b,c", "", "d\te", "f", " 日 x."], pa.string())], ["text"])
    words = collocations.words_of(part)
    kept = np.array([0, 1, 3, 4, 5, 7])
    joined = np.array([True, False, True, False, False, False])
    assert collocations._cut_down(words, kept, joined).to_pylist() == ["aé b\n", "", "d e", "f", "x\n"]


def test_phrases_of_one_hash_are_counted_by_their_words(documents, monkeypatch):
    """Where the second hash tells a clash, the last scan counts by words, whatever slots are marked."""
    import numpy as np
    from pyspark.sql import functions as F

    whole = collocations.frequent_hashes

    def clashing_hashes(*args):
        frequent, wanted = whole(*args)
        return frequent.withColumn("high", F.col("low") + 1), np.ones(1 << collocations.SLOT_BITS, bool)

    monkeypatch.setattr(collocations, "frequent_hashes", clashing_hashes)
    rows = corpus(12, 6)
    assert sorted(as_set(collocations.mine(documents(rows), least=4), *COLUMNS)) == plain(rows, 4, 2000)


def test_a_third_of_all_words_in_one_phrase(documents):
    rows = [(i, "of the of the of the" if i % 3 == 0 else prose(i, 6), "en", "s") for i in range(600)]
    assert sorted(as_set(collocations.mine(documents(rows), least=100), *COLUMNS)) == plain(rows, 100, 2000)


def test_ties_and_the_top(documents):
    rows = [(i, "a b. c d. e f. B A", "en", "s") for i in range(10)]
    assert [r[:3] for r in sorted(as_set(collocations.mine(documents(rows), least=10, top=2), *COLUMNS))] == [("en", 1, "c d"), ("en", 2, "e f")]


def test_products_beyond_64_bits(spark):
    big = 4 * 10**12
    phrases = spark.createDataFrame([
        ("en", 0, "", 9 * 10**13), ("en", 1, "x", big), ("en", 1, "y", big + 1), ("en", 2, "x y", big - 1)], collocations.COUNTS)
    row = collocations.collocations(phrases).first()
    assert row["score"] == 1000 * (big - 1) * 9 * 10**13 // (big * (big + 1))


def test_nothing_to_find(documents, empty):
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(documents([(1, None), (2, ""), (3, "one two three")]), least=2).count() == 0


def test_frequent_phrases(documents):
    rows = corpus(20, 9)
    found, totals = plain_counts(rows)
    expected = [(lang, len(w), " ".join(w), n) for (lang, w), n in found.items() if n >= 5] + [(k, 0, "", n) for k, n in totals.items()]
    assert sorted(as_set(collocations.frequent_phrases(documents(rows), least=5), "lang", "size", "phrase", "n")) == sorted(expected)
