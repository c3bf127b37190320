import hashlib
import random

import numpy as np
import pytest
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import repeats


def brute(rows, length):
    seen, out, done = set(), [], set()
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), []
        for p in range(len(raw) - length + 1):
            window = raw[p: p + length]
            if window in seen:
                gone[p: p + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_odd_rows(odd):
    rows = [r[:2] for r in ODD]
    found = as_set(repeats.remove_repeats(clashing(odd)), *COLUMNS)
    # Rows without an id are in no order among themselves, nor are the two of one id.
    assert sorted(x[1:2] for x in found) == sorted(x[1:2] for x in brute(rows, 100))
    assert sum(x[2] for x in found) == sum(x[2] for x in brute(rows, 100))
    assert sorted((x for x in found if x[0] not in (None,)), key=str) == sorted((x for x in brute(rows, 100) if x[0] not in (None,)), key=str)


def test_stored_documents(stored):
    assert as_set(repeats.remove_repeats(stored), *COLUMNS) == brute([(r.doc_id, r.text) for r in stored.collect()], 100)


@pytest.mark.parametrize("length", [33, 64, 100, 150])
def test_copies_with_edits_periods_and_edges(documents, length):
    rng, rows = random.Random(length), []
    texts = [prose(i, 150) for i in range(3)]
    for i in range(40):
        raw = rng.choice(texts)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(raw))
            raw = raw[:at] + rng.choice(["", "#", "éé", raw[at: at + 200], "ab" * rng.randrange(150)]) + raw[at + rng.randrange(3):]
        rows.append((i, raw[rng.randrange(200):]))
    rows += [(100, "=" * 1000), (101, "=" * 99), (102, "=" * 100), (103, "ab" * 300), (104, "x" + "=" * 120 + "y")]
    assert as_set(repeats.remove_repeats(documents(rows), length), *COLUMNS) == brute(rows, length)


def test_one_passage_in_every_document(documents):
    passage = prose(77, 40)
    rows = [(i, prose(1000 + i, 30) + passage + prose(2000 + i, 30)) for i in range(300)]
    found = repeats.remove_repeats(documents(rows))
    assert as_set(found, *COLUMNS) == brute(rows, 100)


def test_kept_text_is_returned(documents):
    rows = [(1, prose(1, 60)), (2, "new " + prose(1, 60) + " tail")]
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(documents(rows)).collect()}
    assert kept == {1: prose(1, 60).encode(), 2: b"new  tail"}


def test_least_places_and_ranks():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 500, dtype=np.uint64)
    assert repeats.least_places(values, 7).tolist() == [p + int(values[p: p + 7].argmin()) for p in range(494)]
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    places = np.arange(301)
    found = repeats.ranks(data, places, 100)
    strings = [data[p: p + 100].tobytes() for p in places]
    assert [strings[i] for i in np.argsort(found, kind="stable")] == sorted(strings)


def test_empty_table(empty):
    assert repeats.remove_repeats(empty).count() == 0
