"""Texts of an Arrow batch as one byte array, cut into words without a Python loop over them.

Batches are taken in slices of about ``SLICE_BYTES``; a longer text is a slice of its own, so
the memory of a task follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

#: True for the bytes of a word when words are what stands between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of at most ``most`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and where each begins, one more for the end."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0]: starts[-1]], starts - starts[0]


def word_bounds(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs of ``inside``, cut at text bounds, and the runs before each text."""
    filled = starts[:-1][starts[1:] > starts[:-1]]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[filled] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, starts)


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings among ``data`` cut at ``offsets``, and for each string which of them it is."""
    strings = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def packed_words(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """The words' bytes without what stands between them, and their offsets."""
    offsets = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=offsets[1:])
    return data[inside], offsets


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts`` with ``lengths``, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


class IdStore:
    """Token ids of strings seen before, with the number of uses; at most ``most`` strings.

    Beyond that the less used half goes. It saves work only: a string that is not in it is
    encoded anew.
    """

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def slots(self, strings: list[bytes], counts: np.ndarray) -> np.ndarray:
        """A slot for each of the distinct ``strings``, valid until the next call."""
        if len(self.slot) > self.most:
            self._shrink()
        get = self.slot.get
        found = np.fromiter((get(s, -1) for s in strings), np.int64, len(strings))
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = [strings[i] for i in new]
            ids, lengths = self.encode(missing)
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.slot.update(zip(missing, range(base, base + len(new))))
            found[new] = np.arange(base, base + len(new))
        np.add.at(self.uses, found, counts)
        return found

    def _shrink(self) -> None:
        keep = self.uses > np.median(self.uses)
        new = np.cumsum(keep) - 1
        self.slot = {s: int(new[k]) for s, k in self.slot.items() if keep[k]}
        self.ids = gather(self.ids, self.starts[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = self.uses[keep] // 2

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings one after another, and the number of ids of each string."""
        if len(offsets) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        strings, which = distinct(data, offsets)
        slots = self.slots(strings.to_pylist(), np.bincount(which, minlength=len(strings)))[which]
        lengths = self.lengths[slots]
        return gather(self.ids, self.starts[slots], lengths), lengths
