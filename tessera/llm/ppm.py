"""Language-model scores by prediction by partial matching over bytes, pretrained on the corpus.

Text: A-Z lower-cased; words are runs of bytes but white space; a text is the stream of its words, each closed by a space,
and the end token is one more space. Two spaces stand before the first word.

The trie of byte contexts has for every symbol three bytes before it or more, across words: a word's first symbol follows the
last two bytes of the word before and the space, its second the last byte before, the space and the first symbol; from the
third on the context is the space and the whole prefix of the word (up to DEPTH bytes). Below come the last two bytes, the
last byte, none, and equal chances for the rest of the 256 bytes. Escapes are estimated by method D: of a context with T
symbol occurrences, D of them distinct, a symbol seen c times has (2 c - 1) / 2 T and the escape D / 2 T. Those of prefixes
from three bytes on are estimated from the corpus (secondary estimation): each training symbol is left out of its node once,
and how often it would have been new there is counted by classes of T and D. Symbols of the longer context are excluded
from the shorter ones, in numerator and denominator.

What a word's third and later symbols cost depends on the word only and is computed once however often it occurs; its
first two are looked up for each place.

Counts come from all training texts and stay distributed: words are counted by a shuffle with sums made before it;
prefix nodes are made in shards that hold all words with the same first three bytes. Only contexts of up to three bytes
around a space, and of two bytes, are brought to the driver, at most 2 ** 24 counts each whatever the corpus (UTF-8 text
has far fewer). To score texts, these and the HOT_WORDS most frequent words go to every executor (a fixed number); all
other words are joined, so none is left out.

Null text: empty (the end token only). Null id: trained on, not held out. Repeated rows: a row each, and counted as
often as they occur. Empty table: no rows. A text of any length is scored whole. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, give_back, has_columns, kept, materialize, text_rows

DEPTH, HOT_WORDS, FLUSH, SHARD_WORDS = 24, 1 << 18, 400_000, 60_000
FOLDS, HELD_OUT = 7, 2
SPACE = 0x20


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def junctions(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts (lower-cased bytes in a row, and where each ends) -> for every token, the end tokens last: its text, the two
    bytes before the space and the first symbol as a key; for all but the end tokens, the byte before, and the first two
    symbols."""
    word = (data != SPACE) & ((data < 9) | (data > 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = cut[0] = True
    start = np.flatnonzero(word & (~np.append(False, word[:-1]) | cut[:-1]))
    last = np.flatnonzero(word & (~np.append(word[1:], False) | cut[1:]))
    text = np.searchsorted(ends, start, "right")
    one = data[last].astype(np.int64)
    two = np.where(last > start, data[np.maximum(last - 1, 0)], SPACE).astype(np.int64)
    fresh = np.append(True, text[1:] != text[:-1])[: len(start)]  # a text's first word
    y, x = (np.where(fresh, SPACE, np.append(SPACE, v[:-1])[: len(start)]) for v in (one, two))
    first = data[start].astype(np.int64)
    second = np.where(last > start, data[np.minimum(start + 1, len(data) - 1)], SPACE).astype(np.int64) if len(data) else first
    upto = np.searchsorted(text, np.arange(len(ends)), "right") - 1  # a text's last word
    has = upto >= 0
    has[has] = text[upto[has]] == np.flatnonzero(has)
    y_end, x_end = (np.where(has, v[np.maximum(upto, 0)] if len(v) else SPACE, SPACE) for v in (one, two))
    key0 = np.concatenate([(x << 16) | (y << 8) | first, (x_end << 16) | (y_end << 8) | SPACE])
    return np.concatenate([text, np.arange(len(ends))]), key0, (y << 16) | (first << 8) | second, text


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = flat(column)
    return np.frombuffer(data.tobytes().lower(), np.uint8), ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> kind, key, word, c: occurrences in training texts of words (kind 0; words of held-out texts come with 0 at
    least) and of symbols behind two bytes and a space (1) or a byte, a space and a byte (2)."""
    seen: Counter = Counter()
    met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def take() -> pa.RecordBatch:
        n = len(seen)
        out = [np.zeros(n, np.int32), np.zeros(n, np.int64), list(seen), list(seen.values())]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], names=["kind", "key", "word", "c"])

    for part, texts in text_rows(batches):
        train = np.array([not held_out(d) for d in part.column(0).to_pylist()], bool)
        of0, key0, key1, of1 = junctions(*lowered(part.column(1)))
        new = key0[train[of0]], key1[train[of1]]
        met = [_summed(np.append(k, x), np.append(n, np.ones(len(x), np.int64))) for (k, n), x in zip(met, new, strict=True)]
        for learn, raw in zip(train.tolist(), texts, strict=True):
            words = raw.lower().split()
            words.append(b"")
            if learn:
                seen.update(words)
            else:
                for w in set(words):
                    seen.setdefault(w, 0)
            if len(seen) > FLUSH:
                yield take()
    yield take()
    for kind, (key, n) in enumerate(met, 1):
        none = pa.array([b""] * len(key), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), none, pa.array(n)], names=["kind", "key", "word", "c"])
    give_back()


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols of all words, each word's offset, its length, and for every symbol its two bytes of context and itself."""
    sym = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    off = np.append(0, np.cumsum(size + 1))[:-1]
    one = np.append(SPACE, sym[:-1])
    two = np.append(SPACE, one[:-1])
    two[off] = SPACE
    return sym, off, size, (two << 16) | (one << 8) | sym


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.add.reduceat(weight, at) if len(at) else weight


def _short_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, c -> kind 0: symbols in contexts of two bytes; kind 1: third symbols of words after their first two."""
    for batch in batches:
        for k in range(0, batch.num_rows, 50_000):
            part = batch.slice(k, 50_000)
            words, c = part.column(0).to_pylist(), part.column(1).to_numpy()
            _, off, size, key = _flat(words)
            weight = np.repeat(c, size + 1)
            weight[off] = 0  # first symbols follow other words
            k0, n0 = _summed(key[weight > 0], weight[weight > 0])
            long = size >= 2
            k1, n1 = _summed(key[off[long] + 2], c[long])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(k0), len(k1)]).astype(np.int32)), pa.array(np.append(k0, k1)), pa.array(np.append(n0, n1))], names=["kind", "key", "n"])


class Low:
    """Contexts of up to two bytes, the nodes of the first two bytes of a word, and those around a space."""

    def __init__(self, key: np.ndarray, n: np.ndarray, start_key: np.ndarray, start_n: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]]):
        met = [(k[o], c[o]) for k, c in met for o in [np.argsort(k)]]
        self.key, self.n = _summed(np.append(key, self.below(0, met[0][0])), np.append(n, met[0][1]))
        ctx, one, sym = self.key >> 8, (self.key >> 8) & 255, self.key & 255
        self.ctx = np.unique(ctx)
        at = np.searchsorted(self.ctx, ctx)
        c2 = np.zeros((256, 256), np.int64)  # order 1
        np.add.at(c2, (one, sym), self.n)
        c1 = c2.sum(0)  # order 0

        def by(values: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros(size, np.int64)
            np.add.at(out, groups, values)
            return out

        m = len(self.ctx)
        self.t2, self.d2 = by(self.n, at, m), by(np.ones_like(self.n), at, m)
        self.x2 = by(c2[one, sym], at, m)  # what a context's symbols have in the context one byte shorter
        t1, d1 = c2.sum(1), (c2 > 0).sum(1)
        x1 = np.where(c2 > 0, c1, 0).sum(1)
        self.c2, self.t1, self.d1 = c2, t1, d1
        t0, d0 = int(c1.sum()), int((c1 > 0).sum())
        rest0, kinds0 = t0 - x1, d0 - d1
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10((2 * c1[None, :] - 1) / (2 * rest0[:, None]))
            escape = np.where(rest0 > 0, np.log10(kinds0 / (2 * rest0)), 0.0)
        uniform = -np.log10(max(1, 256 - d0))
        #: log10 probability of a symbol by orders 0 and below, after an escape from the byte before
        self.zero = np.where((c1 > 0)[None, :] & (rest0 > 0)[:, None], seen, escape[:, None] + uniform)
        order = np.argsort(start_key)
        self.start_key, start_n = start_key[order], start_n[order]
        self.start_n = start_n
        self.start_ctx = np.unique(self.start_key >> 8)
        where = np.searchsorted(self.start_ctx, self.start_key >> 8)
        self.start_t, self.start_d = by(start_n, where, len(self.start_ctx)), by(np.ones_like(start_n), where, len(self.start_ctx))
        self.start_x = by(find(self.key, self.n, self.start_key), where, len(self.start_ctx))

        self.met = []
        for kind, (key, n) in enumerate(met):
            ctx = np.unique(key >> 8)
            at = np.searchsorted(ctx, key >> 8)
            x = by(find(self.key, self.n, self.below(kind, key)), at, len(ctx))
            self.met.append((key, n, ctx, by(n, at, len(ctx)), by(np.ones_like(n), at, len(ctx)), x))
        self.known = [self.junction(kind, m[0]) for kind, m in enumerate(self.met)]

    @staticmethod
    def below(kind: int, key: np.ndarray) -> np.ndarray:
        """The two bytes before a symbol and itself, for the keys of junctions."""
        return ((key >> 8 & 255) << 16) | (SPACE << 8) | (key & 255) if kind == 0 else (SPACE << 16) | (key & 0xFFFF)

    def junction(self, kind: int, key: np.ndarray) -> np.ndarray:
        """log10 probability of symbols in three bytes of context around a space, by method D and exclusion."""
        keys, n, ctx, ts, ds, xs = self.met[kind]
        c, t, d, x = find(keys, n, key), find(ctx, ts, key >> 8), find(ctx, ds, key >> 8), find(ctx, xs, key >> 8)
        low = self.below(kind, key)
        c2, t2, d2 = find(self.key, self.n, low), find(self.ctx, self.t2, low >> 8), find(self.ctx, self.d2, low >> 8)
        lower = self.two(low, c2, t2 - x, d2 - d, self.one(low))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(c > 0, np.log10((2 * c - 1) / (2 * t)), np.where(t > 0, np.log10(d / (2 * t)), 0.0) + lower)

    def costs(self, kind: int, key: np.ndarray) -> np.ndarray:
        """The same from what was seen in training, and computed for the rest."""
        keys = self.met[kind][0]
        if not len(keys):
            return self.junction(kind, key)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = self.known[kind][at]
        new = np.flatnonzero(keys[at] != key)
        out[new] = self.junction(kind, key[new])
        return out

    def one(self, key: np.ndarray) -> np.ndarray:
        """log10 probability by order 1 and below, after an escape from the two bytes (or without such a context)."""
        ctx = key >> 8
        p, s = ctx & 255, key & 255
        t = self.t1[p] - find(self.ctx, self.x2, ctx)
        d = self.d1[p] - find(self.ctx, self.d2, ctx)
        c = self.c2[p, s]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((c > 0) & (t > 0), np.log10((2 * c - 1) / (2 * t)), np.where(t > 0, np.log10(d / (2 * t)), 0.0) + self.zero[p, s])

    def two(self, key: np.ndarray, c3: np.ndarray, t2: np.ndarray, d2: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probability by order 2 and below; t2, d2 without what is excluded."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((c3 > 0) & (t2 > 0), np.log10((2 * c3 - 1) / (2 * t2)), np.where((t2 > 0) & (d2 > 0), np.log10(d2 / (2 * t2)), 0.0) + below)


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at wanted keys, 0 where there is none; keys ascend."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def kinds_of(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The class of a context by its occurrences and kinds: few of either by themselves, more by powers of two."""
    size = np.where(t < 8, t, 5 + np.floor(np.log2(np.maximum(t, 1)))).astype(np.int64)
    return np.minimum(size, 63) * 16 + np.where(d < 6, d, np.minimum(15, 4 + np.floor(np.log2(np.maximum(d, 1))))).astype(np.int64)


CLASSES = 64 * 16


def prefix_nodes(sym: np.ndarray, off: np.ndarray, size: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes of prefixes of 3 to DEPTH bytes, a depth at a time: the words that reach it, where the symbol runs begin
    among them, flat places of the runs' symbols, their counts, the node of each run and where nodes begin in runs."""
    act, run = np.flatnonzero(size >= 2), None
    for depth in range(3, DEPTH + 1):
        kept = size[act] >= depth
        act = act[kept]
        if not len(act):
            return
        if run is None:
            run = (sym[off[act]] << 16) | (sym[off[act] + 1] << 8) | sym[off[act] + 2]
        else:  # a word that ends sorts before the longer ones of its prefix
            run = np.cumsum(np.append(0, (run[1:] != run[:-1]) | (last[1:] != last[:-1])))[kept]  # noqa: F821
        new = np.append(True, run[1:] != run[:-1])
        at = off[act] + depth
        last = sym[at]
        runs = np.flatnonzero(new | np.append(True, last[1:] != last[:-1]))
        cs = np.add.reduceat(c[act], runs)
        of = np.cumsum(new)[runs] - 1
        yield act, runs, at[runs], cs, of, np.flatnonzero(np.append(True, of[1:] != of[:-1]))


def escapes(words: list[bytes], c: np.ndarray) -> np.ndarray:
    """(CLASSES, 2): how often a training symbol, left out of its prefix node, is new there or not, by the class of the
    node without it."""
    out = np.zeros((CLASSES, 2), np.int64)
    sym, off, size, _ = _flat(words)
    for _, _, _, cs, _, first in prefix_nodes(sym, off, size, c):
        t, d = np.add.reduceat(cs, first), np.add.reduceat((cs > 0).astype(np.int64), first)
        once = np.add.reduceat((cs == 1).astype(np.int64), first)
        ok = t > 1
        np.add.at(out[:, 0], kinds_of(t[ok] - 1, d[ok] - 1), once[ok])
        np.add.at(out[:, 1], kinds_of(t[ok] - 1, d[ok]), t[ok] - once[ok])
    return out


def code_lengths(words: list[bytes], c: np.ndarray, low: Low, see: np.ndarray) -> np.ndarray:
    """log10 probability of each word's third and later symbols. words: ascending, and all words with the first three bytes of any of them;
    see: escape probability of each class of prefix nodes."""
    sym, off, size, key = _flat(words)
    c3 = find(low.key, low.n, key)
    t2, d2 = find(low.ctx, low.t2, key >> 8), find(low.ctx, low.d2, key >> 8)
    below = low.one(key)
    plain = low.two(key, c3, t2, d2, below)

    def node(cs: np.ndarray, t: np.ndarray, d: np.ndarray, x: np.ndarray, at: np.ndarray, e: np.ndarray) -> np.ndarray:
        """What symbols at flat places `at` gain by a prefix node of t occurrences, d kinds, x excluded, escape e."""
        lower = low.two(key[at], c3[at], t2[at] - x, d2[at] - d, below[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(cs > 0, np.log10((1 - e) * (2 * cs - 1) / (2 * t - d)), np.where(t > 0, np.log10(e) + lower, plain[at])) - plain[at]

    priced = plain.copy()
    priced[off] = 0.0
    priced[off[size > 0] + 1] = 0.0
    total = np.add.reduceat(priced, off)  # symbols by short contexts; prefix nodes correct that below
    act = np.flatnonzero(size >= 2)
    if len(act):
        at = off[act] + 2
        k = key[at]
        t, d = find(low.start_ctx, low.start_t, k >> 8), find(low.start_ctx, low.start_d, k >> 8)
        total[act] += node(find(low.start_key, low.start_n, k), t, d, find(low.start_ctx, low.start_x, k >> 8), at, d / np.maximum(1, 2 * t))
    for act, runs, at, cs, of, first in prefix_nodes(sym, off, size, c):
        t, d = np.add.reduceat(cs, first), np.add.reduceat((cs > 0).astype(np.int64), first)
        x = np.add.reduceat(np.where(cs > 0, c3[at], 0), first)
        total[act] += np.repeat(node(cs, t[of], d[of], x[of], at, see[kinds_of(t, d)][of]), np.diff(np.append(runs, len(act))))
    return total


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """word, c, by word -> batches of words, cut between groups of the same first three bytes."""
    words: list[bytes] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            words += batch.column(0).to_pylist()
            counts.append(batch.column(1).to_numpy())
        if len(words) >= SHARD_WORDS:
            n = len(words) - 1
            while n and words[n - 1][:3] == words[-1][:3]:
                n -= 1
            if n:
                c = np.concatenate(counts)
                yield words[:n], c[:n]
                words, counts = words[n:], [c[n:]]
    if words:
        yield words, np.concatenate(counts)


def _escapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = sum((escapes(*x) for x in shards(batches)), np.zeros((CLASSES, 2), np.int64))
    at = np.flatnonzero(out.sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at, 0]), pa.array(out[at, 1])], names=["kind", "new", "old"])


def escape_table(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Escape probability by class; a class that was never met gets that of method D."""
    kind = np.arange(CLASSES)
    t = np.where(kind // 16 < 8, kind // 16, 2.0 ** (kind // 16 - 5))
    d = np.where(kind % 16 < 6, kind % 16, 2.0 ** (kind % 16 - 4))
    out = np.clip(d / np.maximum(1, 2 * t), 1e-6, 0.75)
    for k, new, old in counts:
        out[k] = (new + 0.5) / (new + old + 1)
    return out


def model(docs: DataFrame) -> tuple[DataFrame, int, int, Low]:
    """docs (doc_id, text) -> (word binary, c long, score double), training tokens, distinct training tokens, and the
    short contexts."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, "kind int, key long, word binary, c long").groupBy("kind", "key", "word").agg(F.sum("c").alias("c"))
    counted = materialize(counted, "counted")
    words = counted.filter("kind = 0").select("word", "c")
    around = counted.filter("kind > 0").select("kind", "key", "c").toArrow()  # at most 2 ** 24 of either kind
    of, at, often = (around.column(i).to_numpy() for i in range(3))
    tokens, kinds = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    short = words.filter("c > 0").mapInArrow(_short_contexts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (short.column(i).to_numpy() for i in range(3))
    low = Low(key[kind == 0], n[kind == 0], key[kind == 1], n[kind == 1], [(at[of == k], often[of == k]) for k in (1, 2)])
    dealt = words.repartition(F.substring("word", 1, 3)).sortWithinPartitions("word")
    met = dealt.mapInArrow(_escapes, "kind int, new long, old long").groupBy("kind").agg(F.sum("new"), F.sum("old")).collect()  # CLASSES rows at most
    sent = docs.sparkSession.sparkContext.broadcast((low, escape_table([tuple(r) for r in met])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, c in shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary()), pa.array(c), pa.array(code_lengths(group, c, *sent.value))], names=["word", "c", "score"])

    return materialize(dealt.mapInArrow(score, "word binary, c long, score double"), "scored"), tokens or 0, kinds or 0, low


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs."""
    has_columns(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    words, tokens, kinds, low = model(docs)
    hot = words.orderBy(F.desc("c"), "word").limit(HOT_WORDS).toArrow()
    log_all = float(np.log10(tokens + kinds + 1))
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((hot.column(0).to_pylist(), hot.column(1).to_numpy(), hot.column(2).to_numpy(), low))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, word binary, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, n long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        listed, c, lm, low = sent.value
        place = kept("ppm", name, lambda: {w: i for i, w in enumerate(listed)})
        known, base, lm = np.append(c > 0, False).astype(np.int64), np.append(np.log10(c + 1.0), 0.0), np.append(lm, 0.0)
        uid, none = TaskContext.get().partitionId() << 40, len(listed)
        for part, texts in text_rows(batches):
            rows: list[list] = [[] for _ in range(len(names) - 1)]
            heads: list[int] = []
            of0, key0, key1, of1 = junctions(*lowered(part.column(1)))
            costs = np.bincount(of0, low.costs(0, key0), part.num_rows) + np.bincount(of1, low.costs(1, key1), part.num_rows)
            for i, raw in enumerate(texts):
                words = raw.lower().split()
                words.append(b"")
                at = np.array([place.get(w, none) for w in words], np.int64)
                cold = Counter([words[j] for j in np.flatnonzero(at == none).tolist()])
                doc = part.column(0)[i]
                heads.append(i)
                head = uid, b" %d" % uid, held_out(doc.as_py()), len(words), int(known[at].sum()), float(base[at].sum()), float(lm[at].sum() + costs[i]), 0
                for col, v in zip(rows, head, strict=True):
                    col.append(v)
                for w, n in cold.items():
                    heads.append(-1)
                    for col, v in zip(rows, (uid, w, None, 0, 0, 0.0, 0.0, n), strict=True):
                        col.append(v)
                uid += 1
            docs_at = part.column(0).take(pa.array([None if h < 0 else h for h in heads], pa.int64()))
            types = (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            cols = [pa.array(v, t) for v, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols[:2], docs_at, *cols[2:]], names=names)

    made = docs.mapInArrow(run, schema)
    cold = words.select("word", F.col("c").alias("w_c"), F.col("score").alias("w_score"))
    joined = made.join(cold, "word", "left")
    n = F.coalesce("n", F.lit(0))
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + n * F.coalesce((F.col("w_c") > 0).cast("long"), F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + n * F.coalesce(F.log10(F.col("w_c") + 1.0), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + n * F.coalesce("w_score", F.lit(0.0))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score")
