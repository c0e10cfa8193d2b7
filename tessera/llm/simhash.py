"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at RADIUS = 3 or fewer differing bits. Half of that radius is one bit and a half: the
64 bits are cut into BLOCKS groups, and for each group a fingerprint emits, with the group's bits masked out, itself
and every variant with one further bit flipped. Of three differing bits at most two lie outside the group that holds
one of them (and so do two bits outside a group that holds none), so two fingerprints that link always meet in a
variant: one flip from each side. Variants are shuffled, equal fingerprints having been merged first, and what meets
is verified on all 64 bits. Within a bucket members are looked up by their masked bits (equal, one bit apart; three
bits apart if nothing else differs) instead of being paired, and a spanning forest of the verified links is emitted,
so a bucket of m members gives fewer than m links.

Texts: A-Z lower-cased, words are runs of bytes but white space, shingles of `width` words joined by a space,
repeats included; fewer words: all of them as one shingle; none (null or empty text): fingerprint zero, which links
like any other. Each shingle's XXH64 (seed 42) votes; a bit is set if over half of the hashes have it.

Null ids: the row keeps its fingerprint and class; a class of null ids only has component null. Repeated rows and
ids: a row each. Empty tables: no rows. Further columns are ignored by `classes`, and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, has_columns, map_text, materialize, one_per_id
from .graph import components

RADIUS, BLOCKS, BITS, SEED = 3, 4, 64, 42
WIDTH = BITS // BLOCKS


def fingerprint(raw: bytes, width: int = 3) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    data, n = b" ".join(words), len(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(data, SEED)], "<u8")
    else:
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
        view, h = memoryview(data), xxhash.xxh64_intdigest
        ends = (starts[width:] - 1).tolist()
        hashes = np.fromiter((h(view[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends, strict=True)), "<u8", n - width + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(bits), 255):  # sums of bytes stay in a byte
        votes += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """keys and fp long (the 64 bits as a signed number)."""
    has_columns(docs, *keys, text)

    def each(raw: bytes) -> tuple:
        fp = fingerprint(raw, width)
        return (fp - (1 << 64) if fp >> 63 else fp,)

    return map_text(docs, keys, text, "fp long", each)


def _masks() -> np.ndarray:
    """(BLOCKS, 1 + 48) flips: none, then each bit outside the block."""
    out = []
    for b in range(BLOCKS):
        bits = [i for i in range(BITS) if i // WIDTH != b]
        out.append([0, *(1 << i for i in bits)])
    return np.array(out, np.uint64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = _masks()
    erase = np.array([((1 << WIDTH) - 1) << (WIDTH * b) for b in range(BLOCKS)], np.uint64)
    block = np.repeat(np.arange(BLOCKS, dtype=np.int8), flips.shape[1])
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            fp = batch.column(0).slice(k, 2048).to_numpy().view(np.uint64)
            key = ((fp[:, None, None] ^ flips) & ~erase[:, None]).reshape(len(fp), -1)
            cols = key.ravel().view(np.int64), np.tile(block, len(fp)), np.repeat(fp, key.shape[1]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["variant", "block", "fp"])


def _apart() -> tuple[list[int], list[int]]:
    one = [1 << i for i in range(WIDTH)]
    return one, [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]


def bucket_links(variant: int, block: int, members: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned members that met in a variant."""
    shift, low = WIDTH * block, (1 << WIDTH) - 1
    one, three = _apart()
    parent = {m: m for m in members}
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(a: int, b: int) -> None:
        if (a ^ b).bit_count() <= RADIUS and (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    first: dict[int, int] = {}  # masked bits -> a member; members with the same ones are at most two bits apart
    bare: dict[int, int] = {}  # the same for members that differ from the variant in masked bits only
    for m in sorted(members):
        e = m >> shift & low
        if e in first:
            link(first[e], m)
        else:
            first[e] = m
        if (m ^ variant) & ~(low << shift) == 0:
            bare[e] = m
    for e, m in first.items():
        for d in one:
            if (o := first.get(e ^ d)) is not None and o > m:
                link(m, o)
    if len(bare) > 1:
        if len(bare) <= len(three):
            held = list(bare.items())
            pairs = ((m, o) for i, (e, m) in enumerate(held) for f, o in held[:i] if (e ^ f).bit_count() <= RADIUS)
        else:
            pairs = ((m, bare[e ^ d]) for e, m in bare.items() for d in three if e ^ d in bare)
        for m, o in pairs:
            link(m, o)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by variant, then fingerprint -> links."""
    a: list[int] = []
    b: list[int] = []
    rest = (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64))

    def starts(key: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))

    def close(key: np.ndarray, block: np.ndarray, fp: np.ndarray) -> None:
        """All buckets in these rows are whole."""
        if len(key) < 2:
            return
        at = starts(key, block)
        size = np.diff(np.append(at, len(key)))
        for s, n in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            members = list(dict.fromkeys(fp[s : s + n].tolist()))
            if len(members) == 2:
                if (members[0] ^ members[1]).bit_count() <= RADIUS:
                    a.append(members[0])
                    b.append(members[1])
            elif len(members) > 2:
                for x, y in bucket_links(int(key[s]), int(block[s]), members):
                    a.append(x)
                    b.append(y)

    def take() -> pa.RecordBatch:
        pairs = np.unique(np.array([a, b], np.uint64).T.reshape(-1, 2), axis=0)
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([rest[0], batch.column(0).to_numpy().view(np.uint64)])
        block = np.concatenate([rest[1], batch.column(1).to_numpy()])
        fp = np.concatenate([rest[2], batch.column(2).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        cut = int(starts(key, block)[-1])
        close(key[:cut], block[:cut], fp[:cut])
        rest = (key[cut:].copy(), block[cut:].copy(), fp[cut:].copy())
        if len(a) > 100_000:
            yield take()
    close(*rest)
    yield take()


def links(fps: DataFrame) -> DataFrame:
    """Distinct fp long -> (a, b) signed fingerprints of a spanning set of links."""
    variants = fps.select("fp").mapInArrow(_variants, "variant long, block byte, fp long")
    met = variants.repartition("variant").sortWithinPartitions("variant", "block")
    return met.mapInArrow(_meet, "a long, b long").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least id of the row's class), a row for each row of docs."""
    marked = materialize(fingerprints(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), ["doc_id"], width=width), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(least))
    named = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = named.join(lowest, "component").select("fp", "component_id")
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs that stay when one document of each class does: the one of the least id. Of rows that repeat
    it, one stays; rows of a class without ids stay."""
    found = classes(docs, doc_id, text, width)
    return one_per_id(docs, doc_id, found.filter("doc_id = component_id").select(F.col("doc_id").alias("id")))
