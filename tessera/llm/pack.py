"""Packing by concatenating and cutting.

First pass: each partition turns its documents into token ids and writes them with their place in the partition.
The partitions' totals, a row per partition, give by prefix sums where each partition begins in the one long string
of tokens. Second pass: the string is cut into windows of LENGTH tokens; a document that crosses a boundary gives a
piece on either side. What is left at the end is cut at powers of two, so no sequence is padded.

A word is tokenised once (the vocabulary's pre-tokeniser splits at white space, so no token crosses it) and its ids
are reused; a worker keeps CACHE_WORDS words at most, as arrays, beside those of a slice of SLICE_BYTES. New words of
plain letters are spelt by the vocabulary's own merges, many at a time (Merges); all others by the library. A text of any
length is one row; very long ones are a slice by themselves. Null or empty text: the end token only. Repeated rows and null
ids: packed like any other. Empty table: no rows. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, byte_slices, decode, flat, give_back, has_columns, kept, materialize

LENGTH, END, CACHE_WORDS, SLICE_BYTES = 2048, 1, 500_000, 2 << 20

OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Merges:
    """The vocabulary's merges for many words at once: each round joins, in every word, the pair of least rank (the
    leftmost of equals), until no word has one."""

    NONE = np.uint16((1 << 16) - 1)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        shown, extra = {}, 256  # a byte's letter in the vocabulary: itself if it can be printed, else one from U+0100 on
        for b in range(256):
            if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
                shown[b] = chr(b)
            else:
                shown[b], extra = chr(extra), extra + 1
        self.inner = np.array([ids[shown[b]] for b in range(256)], np.uint16)
        self.last = np.array([ids[shown[b] + end] for b in range(256)], np.uint16)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.many = len(ids)
        if self.many > 1 << 16:
            raise ValueError("a vocabulary of more than 65 536 ids")
        key = np.array([ids[a] * self.many + ids[b] for a, b in pairs], np.uint32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.uint16)
        self.bits = max(4, int(4 * len(pairs)).bit_length())  # of an open-addressed table, a quarter full at most
        self.key, self.rank = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, self.NONE, np.uint16)
        slot, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = self.rank[slot[left]] == self.NONE
            self.rank[slot[left][free]] = left[free]  # the last of several that want a slot has it
            self.key[slot[left][free]] = key[left][free]
            left = left[self.rank[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) * np.uint32(self.many) + b).ravel()
        slot = self.slot(key)
        out = self.rank[slot]
        left = np.flatnonzero((out != self.NONE) & (self.key[slot] != key))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.rank[slot[left]]
            left = left[(out[left] != self.NONE) & (self.key[slot[left]] != key[left])]
        return out.reshape(a.shape)

    def spell(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of bytes (lower-cased) and their lengths -> ids, a row each, and their numbers."""
        out, many = np.zeros(raw.shape, np.uint16), np.zeros(len(size), np.int64)
        for n in np.unique(size[size > 0]).tolist():
            which = np.flatnonzero(size == n)
            sym = self.inner[raw[which, :n]]
            sym[:, -1] = self.last[raw[which, n - 1]]
            rank = self.ranks(sym[:, :-1], sym[:, 1:])
            while len(which):
                width = rank.shape[1]
                at = rank.argmin(1) if width else np.zeros(len(which), np.int64)
                best = rank[np.arange(len(which)), at] if width else np.full(len(which), self.NONE)
                go = best < self.NONE
                out[which[~go], : width + 1] = sym[~go]
                many[which[~go]] = width + 1
                which, at, sym, rank = which[go], at[go], sym[go], rank[go]
                row, col = np.arange(len(which)), np.arange(width)
                sym[row, at] = self.made[best[go]]
                sym = np.take_along_axis(sym, col + (col > at[:, None]), 1)
                rank = np.take_along_axis(rank, col[:-1] + (col[:-1] >= at[:, None]), 1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                rank[left, at[left] - 1] = self.ranks(sym[left, at[left] - 1], sym[left, at[left]])
                rank[right, at[right]] = self.ranks(sym[right, at[right]], sym[right, at[right] + 1])
        return out, many


#: What a byte is: white space, a letter, the first of two bytes of a letter, or a stop or symbol (all of ASCII but the apostrophe).
_SPACE, _LETTER, _LEAD, _SIGN = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(9, 14)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0xC3] = _LEAD
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_SECOND = np.zeros(256, bool)  # what may follow _LEAD: U+00C0 to U+00FF but the signs of multiplication and division
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # of the first bytes of eight
LONGEST = 8 * len(_MIX)  #: bytes of a key: those of a word, of which there are fewer, and at the end their number


class Ids:
    """Token ids of words. Words of fewer than LONGEST bytes are known by these bytes, in an open-addressed table, and kept until
    CACHE_WORDS are held, when the half that was met least lately goes."""

    BITS = 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.key = [np.zeros(0, np.uint64) for _ in _MIX]
        self.hash = np.zeros(0, np.uint64)
        self.at, self.many, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.pool, self.turn, self.slots = np.zeros(0, np.uint32), 0, np.full(1 << self.BITS, -1, np.int32)

    def library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and their numbers."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([decode(w) for w in words], add_special_tokens=False)] if words else []
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def spelt(self, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words as keys. Letters whose lower case is one letter of as many bytes that no composition changes,
        then stops or symbols: two tokens of the pre-tokeniser, spelt by Merges. Other words: by the library."""
        raw = key.view(np.uint8).reshape(len(key), -1)
        col = np.arange(LONGEST)
        inside = col < size[:, None]
        kind = np.where(inside, _KIND[raw], 0)
        lead = np.zeros_like(inside)
        lead[:, :-1] = (kind[:, :-1] == _LEAD) & _SECOND[raw[:, 1:]]
        letter = (kind == _LETTER) | lead
        letter[:, 1:] |= lead[:, :-1]
        core = np.argmin(letter, 1)  # letters before anything else
        plain = (core > 0) & ((col < core[:, None]) | ~inside | (kind == _SIGN)).all(1)
        second = np.zeros_like(inside)
        second[:, 1:] = lead[:, :-1]
        lower = np.where((kind == _LETTER) | second & (raw < 0x9F), raw | 0x20, raw)
        rows, core = np.flatnonzero(plain), core[plain]
        cores = np.where(col < core[:, None], lower[rows], np.uint8(0))
        k = cores.view(np.uint64).reshape(len(rows), len(_MIX))
        order = np.argsort((k[:, 0] * _MIX[0]) ^ (k[:, 1] * _MIX[1]) ^ (k[:, 2] * _MIX[2]))
        differs = np.ones(len(rows), bool)
        for i in range(len(_MIX)):
            x = k[order, i]
            differs[1:] = x[1:] != x[:-1] if i == 0 else differs[1:] | (x[1:] != x[:-1])
        of = np.empty(len(rows), np.int64)
        of[order] = np.cumsum(differs) - 1
        some = order[differs]
        a, m = self.merges.spell(cores[some], core[some])
        tail = size[rows] - core
        moved = np.take_along_axis(raw[rows], np.minimum(col + core[:, None], LONGEST - 1), 1)
        has = np.flatnonzero(tail)
        b, n = self.merges.spell(moved[has], tail[has])
        many = np.zeros(len(key), np.int64)
        many[rows] = m[of]
        many[rows[has]] += n
        rest = np.flatnonzero(~plain)
        ids, k = self.library([raw[i, : size[i]].tobytes() for i in rest])
        many[rest] = k
        at = np.cumsum(many) - many
        out = np.zeros(int(many.sum()), np.uint32)

        def put(where: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
            out[np.repeat(where - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))] = values

        put(at[rows], m[of], a[of][np.arange(LONGEST) < m[of][:, None]])
        put(at[rows[has]] + m[of][has], n, b[np.arange(LONGEST) < n[:, None]])
        put(at[rest], k, ids)
        return out, many

    def find(self, key: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """The place of each word in the table, -1 where it is not held."""
        slot, mask = (h >> np.uint64(64 - self.BITS)).astype(np.int64), (1 << self.BITS) - 1
        out, left = self.slots[slot], None
        while True:
            sub = slice(None) if left is None else left
            found = out[sub]
            again = found >= 0
            if len(self.hash):
                ok = self.key[0][found] == key[0][sub]
                for mine, asked in zip(self.key[1:], key[1:], strict=True):
                    ok &= mine[found] == asked[sub]
                again &= ~ok
            if not again.any():
                return out
            left = np.flatnonzero(again) if left is None else left[again]
            slot[left] = (slot[left] + 1) & mask
            out[left] = self.slots[slot[left]]

    def enter(self, begin: int) -> None:
        """Words from place `begin` on into the table."""
        mask, left = (1 << self.BITS) - 1, np.arange(begin, len(self.hash))
        slot = (self.hash[begin:] >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + 1) & mask

    def words(self, key: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in the pool, and their number."""
        self.turn += 1
        h = sum((k * m for k, m in zip(key, _MIX, strict=True)), np.zeros(len(size), np.uint64))
        h ^= h >> np.uint64(32)
        h *= _MIX[0]
        place = self.find(key, h)
        new = np.flatnonzero(place < 0)
        if len(new):
            new = new[np.argsort(h[new], kind="stable")]
            g, k = h[new], [x[new] for x in key]
            first = np.append(True, g[1:] != g[:-1])
            for x in k:
                first[1:] |= x[1:] != x[:-1]  # of words that share a hash, one may come twice: both entries are right
            some = np.flatnonzero(first)
            begin = len(self.hash)
            ids, n = self.spelt(np.stack([x[some] for x in k], 1), size[new][some])
            place[new] = begin + np.cumsum(first) - 1
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
            self.pool, self.many = np.concatenate([self.pool, ids]), np.concatenate([self.many, n])
            self.hash, self.key = np.concatenate([self.hash, g[some]]), [np.concatenate([x, y[some]]) for x, y in zip(self.key, k, strict=True)]
            self.met = np.concatenate([self.met, np.full(len(some), self.turn)])
            if 2 * len(self.hash) > len(self.slots):  # a very long text may have as many words
                self.BITS = int(4 * len(self.hash)).bit_length()
                self.slots, begin = np.full(1 << self.BITS, -1, np.int32), 0
            self.enter(begin)
        self.met[place] = self.turn
        return self.at[place], self.many[place]

    def tidy(self) -> None:
        """Once a slice is written: drop what was met least lately if too much is held."""
        if len(self.hash) > CACHE_WORDS:
            stay = np.flatnonzero(self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2])
            at, self.many, self.met = self.at[stay], self.many[stay], self.met[stay]
            self.hash, self.key = self.hash[stay], [x[stay] for x in self.key]
            self.pool = self.pool[np.repeat(at - np.cumsum(self.many) + self.many, self.many) + np.arange(int(self.many.sum()))]
            self.at = np.cumsum(self.many) - self.many
            self.slots[:] = -1
            self.enter(0)


def encode(data: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts, one after the other as bytes, and where each ends -> the ids of all, and each text's number of them, the end
    token included."""
    table = kept("pack", path, lambda: Ids(path))
    word = _KIND[data] != _SPACE
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = cut[0] = True
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    start = np.flatnonzero(word & (~before | cut[:-1]))
    size = np.flatnonzero(word & (~after | cut[1:])) + 1 - start
    text = np.searchsorted(ends, start, "right")
    short = size < LONGEST
    padded = np.append(data, np.zeros(LONGEST, np.uint8))
    eight = np.ndarray((len(data) + LONGEST - 7,), "<u8", padded, strides=(1,))
    s, n = start[short], size[short]
    at, many = (np.zeros(len(start), np.int64) for _ in range(2))
    key = [eight[s + 8 * i] & _MASKS[np.clip(n - 8 * i, 0, 8)] for i in range(len(_MIX))]
    key[-1] |= n.astype(np.uint64) << np.uint64(56)
    at[short], many[short] = table.words(key, n)
    long = np.flatnonzero(~short)
    ids, many[long] = table.library([data[a : a + n].tobytes() for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)])
    pool = np.concatenate([table.pool, ids, np.array([END], np.uint32)])
    at[long] = len(table.pool) + np.cumsum(many[long]) - many[long]
    last = np.searchsorted(text, np.arange(len(ends)), "right")  # the end token stands after a text's words
    at, many = np.insert(at, last, len(pool) - 1), np.insert(many, last, 1)
    upto = np.cumsum(many)
    out = pool[np.repeat(at - upto + many, many) + np.arange(int(many.sum()))]
    table.tidy()
    stop = upto[last + np.arange(len(ends))] if len(ends) else upto[:0]
    return out, np.diff(stop, prepend=0)


def tokens(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """doc_id, ids, n, and the document's partition and place in it."""
    key = docs.select(doc_id).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), 0
        for part in byte_slices(batches, SLICE_BYTES):
            ids, n = encode(*flat(part.column(1)), path)
            stop = at + np.cumsum(n)
            bounds = pa.py_buffer(np.append(0, 4 * np.cumsum(n)).astype(np.int32 if ids.nbytes < 1 << 31 else np.int64))
            packed = (pa.BinaryArray if ids.nbytes < 1 << 31 else pa.LargeBinaryArray).from_buffers(pa.binary() if ids.nbytes < 1 << 31 else pa.large_binary(), len(n), [None, bounds, pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), pid, np.int32)), pa.array(stop - n), pa.array(n), packed], names=["doc_id", "pid", "at", "n", "ids"])
            at = int(stop[-1])
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {key.dataType.simpleString()}, pid int, at long, n long, ids binary")


def cuts(total: int, length: int) -> tuple[int, np.ndarray]:
    """(whole windows, starts of the sequences after them): powers of two, largest first."""
    whole, rest = divmod(total, length)
    at, out = whole * length, []
    while rest:
        step = 1 << (rest.bit_length() - 1)
        out.append(at)
        at, rest = at + step, rest - step
    return whole, np.array([*out, at], np.int64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "", length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the piece's ids, a row for each piece."""
    import public_tokenizers as P

    has_columns(docs, doc_id, text)
    held = materialize(tokens(docs, doc_id, text, path or P.path("word_bpe_49k.json")), "tokens")
    # a row per partition of the input: as many as tasks, which the driver holds anyway
    totals = {r.pid: r.n for r in held.groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for pid in sorted(totals):
        base[pid] = total
        total += totals[pid]
    whole, tail = cuts(total, length)
    key = held.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *arrow_type(OUT).names, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, start, size, crc, full, seq, off, ids = [], [], [], [], [], [], [], []
                for i, (pid, at, n, data) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                    done, pos = 0, base[pid] + at
                    while done < n:
                        if pos < whole * length:
                            s, first, end = pos // length, pos - pos % length, pos - pos % length + length
                        else:
                            j = int(np.searchsorted(tail, pos, "right")) - 1
                            s, first, end = whole + j, int(tail[j]), int(tail[j + 1])
                        m = min(n - done, end - pos)
                        piece = data[4 * done : 4 * (done + m)]
                        for col, v in zip((row, start, size, crc, full, seq, off, ids), (i, done, m, zlib.crc32(piece), n, s, pos - first, piece), strict=True):
                            col.append(v)
                        done, pos = done + m, pos + m
                part_ids = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, full, seq, off)), part_ids], names=names)
        give_back()

    return held.select("doc_id", "pid", "at", "n", "ids").mapInArrow(run, f"doc_id {key}, {OUT}, ids binary")
