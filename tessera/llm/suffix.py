r"""Exact removal of repeated strings of MATCH bytes by suffix arrays of shards.

What is decided: a byte goes if a MATCH-byte string that covers it also starts earlier (smaller id, or same id and an
earlier start). Matches never cross documents; all is judged on the input.

1. Every window of MATCH bytes has one anchor, the GRAM-byte substring of least hash in it (leftmost of equals), which
   depends on the window's bytes only: equal windows have equal anchors at equal places. The windows of an anchor are
   neighbours and make up a context, MATCH to 2 * MATCH - GRAM bytes long. Equal contexts are merged, first within a
   task (so a passage that a third of the documents share meets in few rows), then in the shuffle by anchor: all
   windows of a later one go.
2. Different contexts of one anchor may share some windows. Their bytes are brought together, again by anchor, and
   each shard, a batch of such groups, is suffix-sorted; runs of suffixes that agree on MATCH bytes are the equal
   windows, and all but the earliest of a run go.
3. Removed stretches are united for each document.

The suffix array (Baier's grouping construction, CPM 2016): suffixes are grouped by first symbol; groups are processed
in descending order; every member points to the nearest suffix before it in a lower group, and what is pointed at
moves to a new group behind its own, those pointed at more often further up. When all groups are processed, they are
the groups of equal Lyndon prefix, in order. The order within a group follows in one ascending pass: from each suffix
in final order, the chain of pointers from its left neighbour is put at the front of the groups. Nothing is renamed
or sorted recursively.

Null text: empty. Null id: after all others. Rows that repeat an id count as one document: a start is earlier if its
offset is smaller. Empty tables: no rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, give_back, has_columns, materialize, text_rows

MATCH, GRAM = 100, 32
NONE = (1 << 63) - 1  #: stands for a null id
PIECE = 1 << 18  #: bytes of a document that are hashed at once
CHUNK = 100_000  #: contexts that are merged within a task
STRETCHES = 20_000  #: removed stretches that are held before they are handed on
SHARD = 1 << 14  #: bytes of a batch of groups

_A = 0x9E3779B97F4A7C15
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every substring of `gram` (a power of two) bytes."""
    h, step, mul = _BYTE[data], 1, _A
    while step < gram:
        h = h[:-step] * np.uint64(mul) + h[step:]
        step, mul = 2 * step, mul * mul % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: bytes, match: int = MATCH, gram: int = GRAM) -> list[np.ndarray]:
    """Columns hash, anchor's place, first window, last window of every context of a document."""
    out = [[np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3]
    low, goal, n = np.uint64(PIECE - 1), match - gram + 1, len(raw) - match + 1
    for base in range(0, n, PIECE - match):
        part = np.frombuffer(raw, np.uint8, min(PIECE - 1, len(raw) - base), base)
        h = gram_hashes(part, gram)
        m, width = h & ~low | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= goal:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < goal:
            m = np.minimum(m[: width - goal], m[goal - width :])
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        a = at[first]
        out.append([h[a], a + base, first + base, last + base])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if len(out) != 2 else out[1]


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of a list of ints >= 1, by descending Lyndon-prefix groups; an implied 0 ends the list."""
    text = [*symbols, 0]
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, prev = [0] * n, [-1] * n  # group: where the suffix's group begins in the suffix array
    members: list[list[int]] = [[]] * (n + 1)  # by a group's begin; may still hold suffixes that have moved on
    stop, begin, at = [0] * (n + 1), [0] * (n + 1), 0  # a group's end by its begin, and its begin by its end
    for c in sorted(by_symbol):
        held = by_symbol[c]
        for i in held:
            group[i] = at
        members[at], stop[at], begin[at + len(held)] = held, at + len(held), at
        at += len(held)
    end = n
    while end:
        g = begin[end]
        held = members[g]
        if end - g == 1:
            i = held[0] if len(held) == 1 else next(x for x in held if group[x] == g)
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                old = group[j]
                top = stop[old]
                if top - old > 1:
                    new = group[j] = stop[old] = begin[top] = top - 1
                    members[new], stop[new], begin[new] = [j], top, old
            end = g
            continue
        held = [x for x in held if group[x] == g]
        held.sort()
        aimed: dict[int, int] = {}
        for i in held:
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            if j >= 0:
                if group[j] == g:
                    j = prev[j]
                    if j < 0:
                        continue
                prev[i] = j
                aimed[j] = aimed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in aimed.items():
            moves.setdefault((-k, group[j]), []).append(j)
        for _, old in sorted(moves) if len(moves) > 1 else list(moves):
            js = moves[_, old]
            top = stop[old]
            new = top - len(js)
            if new > old:
                for j in js:
                    group[j] = new
                members[new], stop[new], begin[top], stop[old], begin[new] = js, top, new, new, old
        end = g
    return _order(group, prev)


def _order(group: list[int], prev: list[int]) -> list[int]:
    n = len(group)
    out, front, done = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = prev[j]
    return out[1:]


def equal_windows(contexts: list[bytes], match: int = MATCH) -> Iterator[list[tuple[int, int]]]:
    """Groups of two or more (context, offset) whose next `match` bytes are equal, by a suffix array of all contexts."""
    symbols: list[int] = []
    where: dict[int, tuple[int, int]] = {}
    for c, data in enumerate(contexts):
        for o in range(len(data) - match + 1):
            where[len(symbols) + o] = (c, o)
        symbols += [b + 2 for b in data]
        symbols.append(1)
    run: list[tuple[int, int]] = []
    now = None
    for p in suffix_array(symbols):
        if p in where:
            c, o = where[p]
            window = contexts[c][o : o + match]
            if window == now:
                run.append((c, o))
                continue
            if len(run) > 1:
                yield run
            run, now = [(c, o)], window
    if len(run) > 1:
        yield run


ROW = "gram long, ctx long, doc long, tag long, place long, first long, last long"
_NAMES = ["gram", "ctx", "doc", "tag", "place", "first", "last"]
GONE = 0  #: ctx of a row that says that its windows go


def tag_of(raw: bytes) -> int:
    """What Spark's xxhash64 gives for the text: tells rows apart that share an id."""
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - (1 << 64) if h >> 63 else h


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> a row per context; of those that are equal within a chunk, all but the first are marked GONE and
    named by their document, so that they spread over the shuffle."""
    docs: list[int] = []
    tags: list[int] = []
    found: list[list[np.ndarray]] = []
    hashes: list[int] = []

    def take() -> pa.RecordBatch:
        many = [len(x[0]) for x in found]
        gram, place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        ctx = np.array(hashes, np.uint64)
        doc = np.repeat(np.array(docs, np.int64), many)
        order = np.lexsort((first, doc, ctx, gram))
        g, c = gram[order], ctx[order]
        same = np.append(False, (g[1:] == g[:-1]) & (c[1:] == c[:-1]))
        later = np.zeros(len(order), bool)
        later[order] = _not_first(same, doc[order], first[order])
        gram[later] = (doc[later].view(np.uint64) + np.uint64(1)) * np.uint64(_A)
        ctx[later] = GONE
        cols = [gram.view(np.int64), ctx.view(np.int64), doc, np.repeat(np.array(tags, np.int64), many), place, first, last]
        for x in (docs, tags, found, hashes):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=_NAMES)

    for part, texts in text_rows(batches):
        for doc, raw in zip(part.column(0).to_pylist(), texts, strict=True):
            if len(raw) < MATCH:
                continue
            cols = anchors(raw)
            view, h = memoryview(raw), xxhash.xxh64_intdigest
            hashes += [h(view[f:e], k) or 1 for f, e, k in zip(cols[2].tolist(), (cols[3] + MATCH).tolist(), (cols[1] - cols[2]).tolist(), strict=True)]
            docs.append(doc)
            tags.append(tag_of(raw))
            found.append(cols)
            if len(hashes) >= CHUNK:
                yield take()
    if found:
        yield take()
    give_back()


def _not_first(same: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of sorted rows, those of the same context as the one before them (same), but for such as stand at the very
    place of the context's first row."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((doc != doc[head]) | (first != first[head]))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, ctx, doc, first -> rows whose windows go (GONE), and the first of each context of a gram
    that has several."""
    rest: list[np.ndarray] | None = None

    def close(cols: list[np.ndarray]) -> pa.RecordBatch:
        gram, ctx = cols[0], cols[1]
        same_gram = gram[1:] == gram[:-1]
        gone = ctx == GONE
        same = np.append(False, same_gram & (ctx[1:] == ctx[:-1])) & ~gone
        later = _not_first(same, cols[2], cols[5])
        head = ~gone & ~same
        at = np.flatnonzero(np.append(True, ~same_gram))
        several = np.repeat(np.add.reduceat(head, at, dtype=np.int64) > 1, np.diff(np.append(at, len(gram)))) if len(gram) else head
        ctx = np.where(later, GONE, ctx)
        out = gone | later | head & several
        return pa.RecordBatch.from_arrays([pa.array(v[out]) for v in (gram, ctx, *cols[2:])], names=_NAMES)

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(len(_NAMES))]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
        if cut:
            yield close([c[:cut] for c in cols])
        rest = [c[cut:].copy() for c in cols]
    if rest is not None:
        yield close(rest)
    give_back()


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _reach(sides: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any other of the list."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for x, y in zip(order, order[1:], strict=False):
        n = common(sides[x], sides[y])
        out[x], out[y] = max(out[x], n), n
    return out


def trimmed(contexts: list[tuple[bytes, int]], match: int = MATCH) -> list[tuple[int, int]]:
    """(begin, end) of what of each context (bytes, anchor's offset) another of the group can share around the anchor;
    (0, 0) where that is less than a window."""
    left = _reach([data[:at][::-1] for data, at in contexts])
    right = _reach([data[at:] for data, at in contexts])
    return [(at - x, at + y) if x + y >= match else (0, 0) for (_, at), x, y in zip(contexts, left, right, strict=True)]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram -> the windows that go, as stretches of window starts.

    Of a group's contexts, what no other can share is cut off, and equal rests are merged (their rows go along); a
    shard is a batch of groups."""
    shard: list[bytes] = []
    owners: list[tuple[int, int, int]] = []  # of each string of the shard: (doc, place of its first byte, tag)
    gone: list[tuple[int, int, int, int]] = []
    size = 0

    def add(rows: list[tuple]) -> int:
        if len(rows) < 2:
            return 0
        by: dict[bytes, list[tuple[int, int, int]]] = {}
        for (_, doc, tag, first, place, data), (b, e) in zip(rows, trimmed([(r[5], r[4] - r[3]) for r in rows]), strict=True):
            if e > b:
                by.setdefault(data[b:e], []).append((doc, first + b, tag))
        for data, held in by.items():
            held.sort()
            gone.extend((doc, tag, p, p + len(data) - MATCH) for doc, p, tag in held[1:] if (doc, p) != held[0][:2])
            if len(by) > 1:  # a group of which one string is left has nothing more to compare
                shard.append(data)
                owners.append(held[0])
        return sum(map(len, by)) if len(by) > 1 else 0

    def close() -> pa.RecordBatch:
        for run in equal_windows(shard):
            places = sorted((owners[c][0], owners[c][1] + o, owners[c][2]) for c, o in run)
            gone.extend((doc, tag, p, p) for doc, p, tag in places[1:] if (doc, p) != places[0][:2])
        gone.sort()
        out: list[list[int]] = [[], [], [], []]
        for doc, tag, a, b in gone:
            if out[0] and (out[0][-1], out[1][-1]) == (doc, tag) and a <= out[3][-1] + 1:
                out[3][-1] = max(out[3][-1], b)
            else:
                for col, v in zip(out, (doc, tag, a, b), strict=True):
                    col.append(v)
        shard.clear()
        owners.clear()
        gone.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["doc", "tag", "first", "last"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held and held[0][0] != row[0]:
                size += add(held)
                held = []
                if size >= SHARD or len(gone) >= STRETCHES:
                    yield close()
                    size = 0
            held.append(row)
    add(held)
    yield close()
    give_back()


def removed_windows(docs: DataFrame) -> DataFrame:
    """docs (doc long, never null; text) -> doc, tag, first, last: stretches of starts of windows that go."""
    made = docs.select("doc", "text").mapInArrow(_contexts, ROW)
    settled = materialize(made.repartition("gram").sortWithinPartitions("gram", "ctx", "doc", "first").mapInArrow(_settle, ROW), "contexts")
    sure = settled.filter(F.col("ctx") == GONE).select("doc", "tag", "first", "last")
    mixed = settled.filter(F.col("ctx") != GONE).select("doc", "tag", "gram", "place", "first", "last")
    body = docs.select(F.col("doc").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("body"))
    data = F.expr(f"substring(body, cast(first + 1 as int), cast(last - first + {MATCH} as int))")
    shards = mixed.join(body, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t"))).select("gram", "doc", "tag", "first", "place", data.alias("data"))
    found = shards.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort, "doc long, tag long, first long, last long")
    return sure.unionByName(found)


def stretches(windows: list[tuple[int, int]], match: int = MATCH) -> list[tuple[int, int]]:
    """Starts (first, last) of windows that go -> maximal stretches of bytes that go, ends exclusive."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + match))
        else:
            out.append((a, b + match))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts are wanted, kept binary and spans
    array<struct<start,end>>, a row for each row of docs. Ids are whole numbers."""
    has_columns(docs, doc_id, text)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} is {kind}, not a whole number")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gone = removed_windows(rows).groupBy("doc", "tag").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    named = rows.withColumn("tag", F.xxhash64("text")).join(gone, ["doc", "tag"], "left").select("doc_id", "text", "first", "last")
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out += ", kept binary, spans array<struct<start:long,end:long>>" if texts else ""
    target = arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts_of in text_rows(batches):
            cols: list[list] = [[] for _ in list(target)[1:]]
            for raw, first, last in zip(texts_of, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                spans = stretches(list(zip(first or [], last or [], strict=True)))
                kept, at, digest = [], 0, hashlib.sha256()
                for a, b in [*spans, (len(raw), len(raw))]:
                    digest.update(raw[at:a])
                    if texts:
                        kept.append(raw[at:a])
                    at = b
                row = len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), b"".join(kept), [{"start": a, "end": b} for a, b in spans]
                for col, v in zip(cols, row, strict=False):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, f.type) for v, f in zip(cols, list(target)[1:], strict=True))], names=target.names)
        give_back()

    return named.mapInArrow(run, out)
