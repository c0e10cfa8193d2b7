"""Near-copies by similarity of five-word shingles: ball hashing proposes, Jaccard decides.

Texts as in simhash: A-Z lower-cased, words are runs of bytes but white space, shingles of WIDTH words (fewer words: all
of them as one shingle). Two texts link if their sets of shingles have a Jaccard similarity of LIMIT or more; texts
without words have the empty set and link to each other only.

Fingerprints have GROUPS * BITS = 126 bits, from the votes of the shingles' XXH3 of 128 bits. At a similarity of 0.8 about 15 %
of them differ, 19 on average, and 28 or more do in few pairs (APART). All bits but those of one group are masked, and a
fingerprint emits the group's value with none or one bit flipped: GROUPS * (1 + BITS) = 133 variants. Texts with at most two
differing bits in some group meet in one of its variants. What meets within APART bits is a candidate; its sets are compared.
So a link can be missed (its bits lie badly), and none is made that the sets do not bear out.

Classes need a spanning set of links only. So each text is first compared with PICKS others: the nearest of those that its
buckets propose (in each the first one before it and the nearest). What that links makes groups, and then all candidates of
different groups are compared, none left out. A large group of near copies is one group by then, and its pairs are never made.

Before the sets themselves are read, sketches rule out most candidates of different groups, and never a link: a set's sketch
has SKETCH bits, each the parity of the shingles that fall on it. Bits that differ between two sketches are shingles that only
one set has, at least one each; a similarity of LIMIT leaves no more than (1 - LIMIT) / (1 + LIMIT) of both sizes to those.

Sets are named by a 64-bit hash of their shingles, so exact copies are merged before. Rows without an id take no part
and stay. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, has_columns, map_text, materialize, one_per_id
from .graph import components

WIDTH, LIMIT, GROUPS, BITS, APART, SMALL, PICKS, SKETCH = 5, 0.8, 7, 18, 28, 256, 8, 512
KEEP = np.uint64((1 << 63) - 1)  # 63 bits of each half


def shingles(raw: bytes) -> list[bytes]:
    words = raw.lower().split()
    return [b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))] if words else []


def marks(raw: bytes) -> tuple[int, int, int, int, bytes]:
    """The name of the text's set of shingles, the two halves of its fingerprint (63 bits each), the set's size and sketch."""
    digest = b"".join(map(xxhash.xxh3_128_digest, sorted(set(shingles(raw)))))
    name = xxhash.xxh3_64_intdigest(digest)
    bits = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 16), axis=1)
    votes = np.zeros(128, np.int64)
    for k in range(0, len(bits), 255):  # sums of bytes stay in a byte
        votes += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    a, b = (np.packbits(2 * votes > len(bits)).view("<u8") & KEEP).tolist()
    odd = np.bincount(np.frombuffer(digest, "<u2")[::8] % SKETCH, minlength=SKETCH) & 1
    return name - (1 << 64) if name >> 63 else name, a, b, len(bits), np.packbits(odd.astype(np.uint8)).tobytes()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, a, b -> variant (group and its bits), name, a, b."""
    flips = np.array([0, *(1 << i for i in range(BITS))], np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            name, a, b = (batch.column(i).slice(k, 2048).to_numpy() for i in range(3))
            low = (1 << BITS) - 1
            at = [(a >> (BITS * g) if g < 3 else (b >> (BITS * (g - 3)) if g < 6 else (a >> 54) | ((b >> 54) << 9))) & low for g in range(GROUPS)]
            key = np.concatenate([((x[:, None] ^ flips) | (g << BITS)) for g, x in enumerate(at)], axis=1)
            n = key.shape[1]
            cols = key.ravel().astype(np.int32), np.repeat(name, n), np.repeat(a, n), np.repeat(b, n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["variant", "name", "a", "b"])


def candidates(key: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, and distances of rows of one key within APART bits and in different groups; rows are sorted by
    key. In parts, all pairs of a j in one part."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(starts, len(key)))
    left, right, apart = [], [], []
    at = np.flatnonzero(np.repeat(size, size) <= SMALL)
    step = 1
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        d = np.bitwise_count(a[at] ^ a[at + step]) + np.bitwise_count(b[at] ^ b[at + step])
        ok = (d <= APART) & (group[at] != group[at + step])
        left.append(at[ok])
        right.append(at[ok] + step)
        apart.append(d[ok])
        step += 1
    if left:
        yield np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for k in range(s + 1, s + n):  # a row at a time, so that memory follows the bucket
            d = np.bitwise_count(a[s:k] ^ a[k]) + np.bitwise_count(b[s:k] ^ b[k])
            i = np.flatnonzero((d <= APART) & (group[s:k] != group[k]))
            if len(i):
                yield i + s, np.full(len(i), k), d[i]


def may_link(size: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sets at i and j can reach LIMIT, by their sizes and sketches (rows of 64-bit words)."""
    apart = np.zeros(len(i), np.int64)
    for word in range(sketch.shape[1]):
        apart += np.bitwise_count(sketch[i, word] ^ sketch[j, word])
    apart = np.maximum(apart, np.abs(size[i] - size[j]))
    return apart * (1 + LIMIT) <= (1 - LIMIT) * (size[i] + size[j]) + 1e-6


def _values(array: pa.Array) -> np.ndarray:
    """A column's numbers, or a row of 64-bit words for each sketch."""
    if pa.types.is_binary(array.type):
        return np.frombuffer(b"".join(array.to_pylist()), np.uint64).reshape(len(array), -1)
    return array.to_numpy()


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, cut between its values."""
    rest: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_values(c) for c in batch.columns]
        rest = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
        cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on
        if cut:
            yield [x[:cut] for x in rest]
        rest = [x[cut:].copy() for x in rest]
    if rest and len(rest[0]):
        yield rest


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """variant, name, a, b -> those that have a candidate in their bucket, with the first one before them and the nearest."""
    for cols in _whole_buckets(batches):
        key, name, a, b = cols
        first, near = np.full(len(key), -1), np.full(len(key), -1)
        apart = [np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)]
        live = np.zeros(len(key), bool)
        for i, j, d in candidates(key, a, b, name):
            if not len(i):
                continue
            live[i] = live[j] = True
            order = np.lexsort((i, j))
            head = order[np.append(True, j[order][1:] != j[order][:-1])]
            first[j[head]], apart[0][j[head]] = i[head], d[head]
            order = np.lexsort((i, d, j))
            head = order[np.append(True, j[order][1:] != j[order][:-1])]
            near[j[head]], apart[1][j[head]] = i[head], d[head]
        at = np.flatnonzero(live)
        picks = [pa.array(name[np.maximum(x[at], 0)], mask=x[at] < 0) for x in (first, near)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in cols] + picks + [pa.array(x[at]) for x in apart], names=["variant", "name", "a", "b", "first", "near", "d_first", "d_near"])
    give_back()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """variant, name, a, b, component, size, sketch -> all candidates of different components that their sketches allow."""
    for key, name, a, b, component, size, sketch in _whole_buckets(batches):
        found = [np.zeros((0, 2), np.int64)]
        for i, j, _ in candidates(key, a, b, component):
            able = may_link(size, sketch, i, j)
            i, j = i[able], j[able]
            found.append(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["x", "y"])
    give_back()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y and the sets of both as sorted 32-bit hashes -> the pairs that reach LIMIT."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32) for c in (2, 3))
            both = np.concatenate([s, t])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if common >= LIMIT * (len(both) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _sets(marked: DataFrame, plain: DataFrame, used: DataFrame) -> DataFrame:
    """name and found (its shingles' 32-bit hashes, sorted) of the sets that are used, each from a text that has it."""
    one = marked.join(used, "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("doc_id"))

    def hashes(raw: bytes) -> tuple:
        found = shingles(raw)
        return marks(raw)[0], np.unique(np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found))).tobytes()

    read = map_text(plain.join(one, "doc_id"), ["name"], "text", "of long, found binary", hashes)
    return read.filter("of = name").dropDuplicates(["name"]).select("name", "found")  # a repeated id has other texts


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id (the least id of the row's class), a row for each row of docs that has an id."""
    has_columns(docs, doc_id, text)
    plain = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    marked = materialize(map_text(plain, ["doc_id"], "text", "name long, a long, b long, size long, sketch binary", marks), "marks")
    sets = materialize(marked.groupBy("name").agg(F.min("doc_id").alias("least"), *(F.min(x).alias(x) for x in ("a", "b", "size", "sketch"))), "names")
    variants = sets.select("name", "a", "b").mapInArrow(_variants, "variant int, name long, a long, b long")
    met = variants.repartition("variant").sortWithinPartitions("variant", "name")
    live = materialize(met.mapInArrow(_live, "variant int, name long, a long, b long, first long, near long, d_first int, d_near int"), "live")
    found = materialize(_sets(marked, plain, live.select("name").distinct()), "sets")

    def verified(pairs: DataFrame, step: str) -> DataFrame:
        joined = pairs.join(found.select(F.col("name").alias("x"), F.col("found").alias("s")), "x").join(found.select(F.col("name").alias("y"), F.col("found").alias("t")), "y")
        return materialize(joined.select("x", "y", "s", "t").mapInArrow(_similar, "a long, b long"), step)

    # of what a text's buckets pick, two each at most, the nearest PICKS; the rest is left to the second step
    both = F.array(F.struct(F.col("d_first").alias("d"), F.col("first").alias("other")), F.struct(F.col("d_near").alias("d"), F.col("near").alias("other")))
    nearest = live.select("name", F.explode(both).alias("p")).filter("p.other IS NOT NULL").groupBy("name").agg(F.slice(F.array_sort(F.collect_set("p")), 1, PICKS).alias("p"))
    picked = nearest.select("name", F.explode("p.other").alias("other"))
    some = verified(picked.select(F.least("name", "other").alias("x"), F.greatest("name", "other").alias("y")).distinct(), "picked")
    group = sets.join(components(some), sets.name == F.col("node"), "left").select("name", F.coalesce("component", "name").alias("component"), "size", "sketch")
    grouped = live.select("variant", "name", "a", "b").join(group, "name").select("variant", "name", "a", "b", "component", "size", "sketch")
    rest = grouped.repartition("variant").sortWithinPartitions("variant", "name").mapInArrow(_across, "x long, y long").distinct()
    linked = components(some.unionByName(verified(rest, "across")))
    named = sets.join(linked, sets.name == linked.node, "left").select("name", "least", F.coalesce("component", "name").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(lowest, "component").select("name", "component_id"), "name").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each class does: the one of the least id. Of rows that repeat
    it, one stays; rows without an id stay."""
    found = classes(docs, doc_id, text)
    return one_per_id(docs, doc_id, found.filter("doc_id = component_id").select(F.col("doc_id").alias("id")))
