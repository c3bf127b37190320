"""License detection: ordered signature rules behind a keyword prefilter.

Words are runs of letters, digits and characters beyond ASCII, after lower-casing A-Z. All words
of a batch are coded at once; a text is looked at only if it holds a keyword, and a rule is run
only if the text holds one of that rule's keywords. Detections are taken by priority, then
length, then place; one whose interval of words lies within an interval already taken is
suppressed. So "GNU General Public License, version 3" is not also reported as the unversioned
license, nor "Lesser General Public License" as the general one.

Base phrases are counted at every place, whatever the rules find, and their labels always stay.
Null and empty texts have no words and no labels and the score 0. The score is the weight of the
surest detection that was taken (0.95 for a base phrase).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import LOWER, distinct, flatten, packed_words, slices, word_bounds
from tidewatch.llm.license_rules import BASE_PHRASES, Rule, rules

RULES: list[Rule] = rules()
BASE = [(re.compile(rf"(?<![^ ])(?={p}(?![^ ]))"), len(p.split()), label, set(p.split())) for p, label in BASE_PHRASES.items()]
BASE_WEIGHT = 0.95

#: Of a base phrase, the word that is a keyword of the prefilter.
KEYWORDS = frozenset().union(*(r.keywords for r in RULES)) | {"mit", "apache", "nc"}

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def detections(words: list[str], found: set[str]) -> list[tuple[Rule, int, int]]:
    """Detections in a text that holds the keywords ``found``: rule, first word, end word."""
    text = " ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    hits = []
    for order, rule in enumerate(RULES):
        if rule.keywords & found:
            for m in rule.pattern.finditer(text):
                first, last = (int(x) for x in np.searchsorted(starts, [m.start(), m.end()]))
                hits.append((rule.priority, first - last, first, order, last))
    taken: list[tuple[Rule, int, int]] = []
    cover = np.zeros(len(words) + 1, np.int64)  # the furthest end of a taken interval that begins here or before
    for _, _, first, order, end in sorted(hits):
        if cover[first] < end:
            taken.append((RULES[order], first, end))
            np.maximum(cover[first:], end, out=cover[first:])
    return taken


def base_places(words: list[str]) -> list[tuple[int, int, str]]:
    """First word, end word and label of each place of a base phrase, overlapping ones included."""
    text = " ".join(words)
    return [
        (at, at + length, label) for pattern, length, label, _ in BASE for m in pattern.finditer(text)
        for at in [text.count(" ", 0, m.start())]
    ]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts and places, labels, score and ``spans``.

    ``spans`` lists the detections taken as (label, first_word, end_word, weight).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("weight", pa.float64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])

    def look(words: list[str], found: set[str]) -> dict:
        base = base_places(words)
        taken = detections(words, found)
        firsts = [b[0] for b in base]
        base_labels = {b[2] for b in base}
        return {
            "n_base": len(base), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {r.label for r, _, _ in taken})),
            "score": max([r.weight for r, _, _ in taken] + [BASE_WEIGHT] * bool(base), default=0.0),
            "spans": [{"label": r.label, "first_word": a, "end_word": b, "weight": r.weight} for r, a, b in taken],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, starts = flatten(part.column("text"))
                data = LOWER[data]
                inside = _WORD[data]
                begins, ends, before = word_bounds(inside, starts)
                raw, offsets = packed_words(data, inside, begins, ends)
                strings, which = distinct(raw, offsets)
                kinds = strings.to_pylist()
                key = np.fromiter((w.decode(errors="replace") in KEYWORDS for w in kinds), bool, len(kinds))
                places = np.flatnonzero(key[which]) if len(which) else np.zeros(0, np.int64)
                holder = np.searchsorted(before, places, "right") - 1
                found: dict[int, set[str]] = {}
                for doc, place in zip(holder.tolist(), which[places].tolist()):
                    found.setdefault(doc, set()).add(kinds[place].decode())
                out = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    row = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
                    if i in found:
                        row = look([kinds[k].decode() for k in which[before[i]: before[i + 1]].tolist()], found[i])
                    out.append(row | {"doc_id": doc_id, "n_words": int(before[i + 1] - before[i])})
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(
        work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:long,end_word:long,weight:double>>"
    )
