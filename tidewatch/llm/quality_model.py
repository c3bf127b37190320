"""Quality score of documents: boosted trees over statistics of the whole text.

Statistics are counts and shares of the text itself (bytes, letters, words, lines, repetition);
language, source, id and labels are never among them. Texts are reduced to a row of numbers
within the scan, the labelled ones are joined by id, and the trees are fitted on at most
``sample`` labelled rows, chosen by a hash of the id (a documented bound: the statistics are few,
and more rows would not change the cuts much). Scoring reads every row.

Null and empty texts have statistics of zero and get the score of those. A row whose id is null
is scored and never labelled. Without any usable label all scores are 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.boosting import Trees, fit
from tidewatch.llm.flat import slices

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "short_line_share", "upper_share", "digit_share",
    "space_share", "high_share", "sentence_share", "comma_share", "bang_share", "question_share", "pipe_share", "mark_share",
    "bracket_share", "quote_share", "at_share", "distinct_word_share", "distinct_line_share", "top_word_share",
    "upper_word_share", "digit_word_share", "long_word_share", "one_letter_share", "repeat_pair_share", "entropy",
)


def _mask(characters: str) -> np.ndarray:
    return np.frombuffer(characters.encode(), np.uint8)


_GROUPS = [
    np.arange(0x41, 0x5B), np.arange(0x30, 0x3A), _mask(" \t\r\n"), np.arange(0x80, 0x100), _mask(".;:"), _mask(","), _mask("!"), _mask("?"),
    _mask("|"), _mask("#$%&*+~^_=\\"), _mask("(){}[]<>"), _mask("'\"`"), _mask("@/"),
]


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of one text."""
    raw = (text or "").encode()
    if not raw.strip():
        return [0.0] * len(STATISTICS)
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    kinds: dict[bytes, int] = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    pairs = set(zip(words, words[1:]))
    line_words = np.fromiter((line.count(b" ") + 1 for line in lines), np.int64, len(lines))
    share = counts[counts > 0] / size
    groups = [float(counts[g].sum()) / size for g in _GROUPS]
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), float(lengths.mean()), n / len(lines), float((line_words < 4).mean()),
        *groups,
        len(kinds) / n, len(set(lines)) / len(lines), max(kinds.values()) / n,
        sum(c for w, c in kinds.items() if w.isupper()) / n, sum(c for w, c in kinds.items() if w[:1].isdigit()) / n,
        float((lengths > 15).mean()), float((lengths == 1).mean()),
        1 - len(pairs) / (n - 1) if n > 1 else 0.0, float(-(share * np.log2(share)).sum()),
    ]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from fitting: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label_col: str = "quality") -> Trees:
    """Fit on the labelled rows that are not held out, at most ``sample`` of them."""
    known = labels.select(F.col("doc_id").alias("known_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out("known_id")).groupBy("known_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("known_id"), "known_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("known_id"), F.col("text").cast("string").alias("text"))
    # ``chosen`` has at most ``sample`` rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "known_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([
                batch.column("known_id").cast(pa.int64()), batch.column("label"), pa.array(list(found), pa.list_(pa.float64())),
            ], ["known_id", "label", "x"])

    # A repeated id may bring more rows than were chosen; the bound on rows holds all the same.
    fitted = rows.mapInArrow(work, "known_id long, label int, x array<double>").orderBy("known_id", "x").limit(sample).toArrow()
    x = np.array(fitted.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array(fitted.column("label").to_pylist(), np.float64)) if len(x) else fit(x, np.zeros(0))


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id")
                x = np.array([statistics(t) for t in part.column("text").to_pylist()], np.float64).reshape(-1, len(STATISTICS))
                scores = model.score(x)
                out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                ], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
