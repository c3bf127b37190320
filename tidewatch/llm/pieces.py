"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The library merges, again and again, the adjacent pair of a text whose joined piece has the
best score, the leftmost of equals. No piece of the models taken here holds a space after
another character, so no merge crosses from a word into the space that begins the next one:
words (with the spaces before them) can be encoded apart. All words of a batch are held as one
flat numpy array of symbols. A round finds the least pair rank of each word, merges its leftmost
place and compacts the array; a word leaves when none of its pairs is a piece. Other places of
the same rank are merged in the same round unless a pair that a merge brings about ranks as
high or higher, in which case the library would take that one first; then the word's other
places wait. So long words need few rounds and the ids are the library's own.

Texts: null and empty give the end id alone and decode to the empty text. The input columns may
have any names; only the id and text columns named by the caller are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import IdStore, flatten, gather, slices

#: What SentencePiece writes for a space (fixed value).
SPACE = "▁"
NO_PAIR = np.int32(2**31 - 1)
#: Text encoded at a time and words remembered: a worker keeps little between tasks.
TEXT_BYTES = 1 << 20
WORDS_KEPT = 120_000


class PieceTable:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model file.

    Raises ValueError for a model whose pieces join words, that lacks byte pieces, or that
    changes texts before encoding, as its ids then cannot be found word by word.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size, self.end_id = model.get_piece_size(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(self.size)]
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError(f"{model_file}: pieces reach across words")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if (self.byte_ids < 0).any() or any(c not in ids for p in ids for c in p):
            raise ValueError(f"{model_file}: needs byte pieces, and a piece for each character of a piece")
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = np.array([model.get_score(i) for i in range(self.size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = sorted(
            (ids[p[:k]] * self.size + ids[p[k:]], rank[i], i)
            for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids
        )
        self._hash_pairs(np.array(pairs, np.int64).reshape(-1, 3))
        blobs = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for value, i in enumerate(self.byte_ids):
            blobs[i] = bytes([value])
        if model.unk_id() >= 0:
            blobs[model.unk_id()] = " \u2047 ".encode()  # what the library writes for it (fixed value)
        self.spaced = np.array([p.startswith(SPACE) and not special[i] for i, p in enumerate(names)])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_lengths = np.array([len(b) for b in blobs], np.int64)
        self.blob_starts = np.cumsum(self.blob_lengths) - self.blob_lengths
        self.texts = np.array([str(i).encode() for i in range(self.size)], object)
        probe = ["a  b ", " é\nＡ\t①", "ﬁx", "Á b"]
        if [self.encode_words([(" " + p).encode()])[0].tolist() for p in probe] != model.encode(probe):
            raise ValueError(f"{model_file}: changes texts before encoding")

    def _hash_pairs(self, pairs: np.ndarray) -> None:
        """Pairs in an open table of two probes per slot; grown until every pair has its place."""
        bits = 2 + int(np.log2(len(pairs) + 2))
        while True:
            self.mask = (1 << bits) - 1
            self.keys = np.full(self.mask + 4, -1, np.int64)
            self.ranks = np.full(self.mask + 4, NO_PAIR, np.int32)
            self.merged = np.full(self.mask + 4, -1, np.int32)
            home = self._home(pairs[:, 0])
            for h, (key, rank, piece) in zip(home.tolist(), pairs.tolist()):
                at = next((h + d for d in range(3) if self.keys[h + d] < 0), None)
                if at is None:
                    break
                self.keys[at], self.ranks[at], self.merged[at] = key, rank, piece
            else:
                return
            bits += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(24)) & np.uint64(self.mask)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of each pair of symbols."""
        keys = left.astype(np.int64) * self.size + right
        at = self._home(keys)
        for _ in range(2):
            at += self.keys[at] != keys
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], NO_PAIR), np.where(hit, self.merged[at], -1)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One symbol per character (byte pieces where there is no piece), and each symbol's word."""
        codes = np.frombuffer(b"".join(words).decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter((len(w.decode()) for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = self.of_char[codes]
        odd = np.flatnonzero(symbol < 0)
        if len(odd):
            raw = [chr(c).encode() for c in codes[odd].tolist()]
            copies = np.ones(len(symbol), np.int64)
            copies[odd] = [len(b) for b in raw]
            first = np.cumsum(copies) - copies
            symbol, word = np.repeat(symbol, copies), np.repeat(word, copies)
            into = np.repeat(first[odd], copies[odd]) + np.concatenate([np.arange(len(b)) for b in raw])
            symbol[into] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, word

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        symbol, word = self.symbols(words)
        done_symbols, done_words = [], []
        rank, joined = self._all_pairs(symbol, word)
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < NO_PAIR, counts)
            if not live.all():
                done_symbols.append(symbol[~live])
                done_words.append(word[~live])
                symbol, word, rank, joined = symbol[live], word[live], rank[live], joined[live]
                if not len(symbol):
                    break
                counts, best = counts[best < NO_PAIR], best[best < NO_PAIR]
            symbol, word, rank, joined = self._round(symbol, word, rank, joined, np.repeat(best, counts))
        ids = np.concatenate([np.zeros(0, np.int32), *done_symbols])
        owners = np.concatenate([np.zeros(0, np.int64), *done_words])
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(words))

    def _all_pairs(self, symbol, word):
        rank = np.full(len(symbol), NO_PAIR, np.int32)
        joined = np.full(len(symbol), -1, np.int32)
        if len(symbol) > 1:
            rank[:-1], joined[:-1] = self.pairs(symbol[:-1], symbol[1:])
            apart = np.flatnonzero(word[1:] != word[:-1])
            rank[apart] = NO_PAIR
        return rank, joined

    def _round(self, symbol, word, rank, joined, best):
        places = np.flatnonzero(rank == best)
        # Of places that overlap, every second one, from the left.
        fresh = np.r_[True, places[1:] != places[:-1] + 1]
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run_start) % 2 == 0]
        leftmost = np.r_[True, word[places[1:]] != word[places[:-1]]]
        if not leftmost.all():
            waits = np.zeros(int(word[-1]) + 1, bool)
            waits[word[places][self._brings_better(symbol, word, joined, best, places)]] = True
            places = places[leftmost | ~waits[word[places]]]
        keep = np.ones(len(symbol), bool)
        keep[places + 1] = False
        symbol = symbol.copy()
        symbol[places] = joined[places]
        new = (np.cumsum(keep) - 1)[places]
        symbol, word, rank, joined = symbol[keep], word[keep], rank[keep], joined[keep]
        touched = np.unique(np.r_[new, new[new > 0] - 1])
        inner = touched[touched < len(symbol) - 1]
        inner = inner[word[inner] == word[inner + 1]]
        rank[touched] = NO_PAIR
        rank[inner], joined[inner] = self.pairs(symbol[inner], symbol[inner + 1])
        return symbol, word, rank, joined

    def _brings_better(self, symbol, word, joined, best, places):
        """Whether a merge at each place makes a pair that the library would take before the next place."""
        merged, limit = joined[places], best[places]
        padded, owner = np.r_[symbol, 0, 0], np.r_[word, -1, -1]
        right = np.where(owner[places + 2] == word[places], self.pairs(merged, padded[places + 2])[0], NO_PAIR)
        behind = np.r_[-9, places[:-1]] == places - 2
        left_symbol = np.where(behind, np.r_[0, merged[:-1]], padded[places - 1])
        left = np.where((places > 0) & (owner[places - 1] == word[places]), self.pairs(left_symbol, merged)[0], NO_PAIR)
        return (right <= limit) | (left <= limit)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids stand one after another, ``counts`` each.

        As the library: byte pieces become bytes (stray ones the replacement character), special
        pieces nothing, and the space put before the first word goes.
        """
        lengths = self.blob_lengths[ids]
        data = gather(self.blob, self.blob_starts[ids], lengths)
        last = np.cumsum(counts)
        ends = np.r_[0, np.cumsum(lengths)][last]
        spaced = self.spaced[np.r_[ids, 0][last - counts]] & (counts > 0)
        raw, out, at = data.tobytes(), [], 0
        for end, space in zip(ends.tolist(), spaced.tolist()):
            out.append(raw[at + space: end])
            at = end
        return [t if _is_utf8(t) else _replace_stray(t) for t in out]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _replace_stray(raw: bytes) -> bytes:
    """Each byte that is part of no character becomes the replacement character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[: error.start].decode() + "�")
            raw = raw[error.start + 1:]
    return "".join(out).encode()


@lru_cache(maxsize=2)
def _table(model_file: str) -> tuple[PieceTable, IdStore]:
    table = PieceTable(model_file)
    return table, IdStore(table.encode_words, WORDS_KEPT)


def encode_texts(texts: pa.Array, model_file: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, the end id behind each, and the ids of each text."""
    table, store = _table(model_file)
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    data, starts = flatten(texts)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[starts[:-1][starts[1:] > starts[:-1]]] = True
    offsets = np.r_[np.flatnonzero(begins), len(data)]
    ids, lengths = store.encode_all(data, offsets)
    id_starts = np.r_[0, np.cumsum(lengths)][np.searchsorted(offsets[:-1], starts)]
    counts = np.diff(id_starts) + 1
    out = np.empty(len(ids) + len(counts), np.int32)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = ids, table.end_id
    return out, counts


def encode_column(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each text with the end id, as int32 array. One row per input row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                ids, counts = encode_texts(part.column("text"), model_file)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return kept.mapInArrow(work, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_column(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; null ids decode to the empty text."""
    kept = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _table(model_file)
        for batch in batches:
            ids = batch.column("ids")
            counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = table.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(work, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass and return the digests of both.

    (doc_id, n_tokens, ids_sha256, decoded_sha256): ids as decimal numbers joined by a space,
    the decoded text in UTF-8, both as lowercase hex of SHA-256.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _table(model_file)
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                ids, counts = encode_texts(part.column("text"), model_file)
                shown, at, sums = table.texts[ids].tolist(), 0, []
                for n in counts.tolist():
                    sums.append(hashlib.sha256(b" ".join(shown[at: at + n])).hexdigest())
                    at += n
                texts = [hashlib.sha256(t).hexdigest() for t in table.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return kept.mapInArrow(work, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
