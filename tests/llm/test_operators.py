"""Each operator against a plain computation of its contract, on documents with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fertility, kdtree, license, mix, pack, pii, ppm, queries, simhash, suffix, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def cases(spark):
    """Whole documents of the smallest table and, under names that clash with the operators' own, awkward rows."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rnd = random.Random(5)
    base = docs[3][1]
    extra = [None, "", " \t\n", "one", "a b", "A B", base, base + " tail", "x " * 60, "ab" * 200, "漢字 かな " * 40, "KK É é ǅ İ", "\x00 \x01 a b"]
    extra += ["mail a.b@c-d.org or @x a@b a@b.c.d ip 1.2.3.4 256.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111111111111112", "call +1 (212) 555-0100 or +12", "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789", "CC BY 4.0; General, Public License! all rights\nreserved all rights reservd"]
    extra += [" ".join(rnd.choice(base.split() or ["z"]) for _ in range(n)) for n in (3, 49, 50, 400)]
    rows = docs + [(100_000 + i, t, None if i % 3 else "en", None if i % 2 else "src0") for i, t in enumerate(extra)]
    rows += [(None, base, "en", "src1"), (docs[0][0], docs[0][1], docs[0][2], docs[0][3]), (docs[1][0], "other text", "en", "")]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return cases(spark)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "w") for r in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "é" * 49, "é" * 50, "é" * 50, "<p>a\r\n\r\nb</p>" * 30, "<p>a\r\n\r\nb</p>" * 30, "short", "short", "é" * 50])]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{d}/pages.parquet")
    rnd = random.Random(1)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(i, [0.25] * 6) for i in range(300, 330)]
    vectors += [(340, None), (360, [None] + [0.5] * 5), (380, [math.nan] * 6), (400, [math.inf] * 6), (420, [0.5] * 4), (None, [0.5] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return d


def same(got, want):
    got, want = sorted(map(repr, got)), sorted(map(repr, want))
    assert got == want, [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


def brute_fingerprint(text, width=3):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark, folder, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = [(r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)]
    same([tuple(x) for x in queries.op1_simhash(spark, folder).collect()], want)


def test_ball_hashing_finds_every_pair(spark):
    rnd = random.Random(3)
    fps = []
    for _ in range(60):
        seed = rnd.getrandbits(64)
        fps.append(seed)
        for n in (1, 2, 3, 3, 3, 4):
            block = rnd.randrange(4)
            bits = rnd.sample(range(16 * block, 16 * block + 16), n) if rnd.random() < 0.4 else rnd.sample(range(64), n)
            fps.append(seed ^ sum(1 << b for b in bits))
    seed = rnd.getrandbits(64)
    fps += [seed ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(400)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)

    def classes(pairs):
        up = {x: x for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        groups = {}
        for x in fps:
            groups.setdefault(root(x), []).append(x)
        return sorted(map(tuple, groups.values()))

    assert classes(found) == classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)


def test_sketches_never_rule_out_a_link():
    """Of random pairs of sets, all with a similarity of 0.8 or more may link by their sketches; of pairs of some hundred
    shingles well below it, few."""
    from tessera.llm import similar

    rnd = random.Random(11)
    below = []
    for n in (1, 4, 5, 6, 9, 60, 200, 350, 3000):
        for _ in range(40):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for _ in range(rnd.randrange(0, 2 + n // 12)):
                k = rnd.randrange(len(other) + 1)
                other[k : k + rnd.randrange(2)] = [f"w{rnd.randrange(10**6)}"] * rnd.randrange(2)
            raw = " ".join(words).encode(), " ".join(other).encode()
            s, t = (set(similar.shingles(x)) for x in raw)
            marked = [similar.marks(x) for x in raw]
            size, sketch = np.array([m[3] for m in marked]), np.stack([np.frombuffer(m[4], np.uint64) for m in marked])
            able = bool(similar.may_link(size, sketch, np.array([0]), np.array([1]))[0])
            alike = len(s & t) / len(s | t) if s | t else 1.0
            assert able or alike < similar.LIMIT
            if 100 <= n <= 400 and alike < 0.7:
                below.append(able)
    assert len(below) > 10 and sum(below) <= 0.1 * len(below)


def test_pipeline_drops_texts_of_similar_shingles(spark, tmp_path):
    """Every pair of 0.8 that a plain search finds is in one class, and no class holds texts that no chain of pairs joins."""
    from tessera.llm import similar

    stage = dict(queries.STAGES)["simhash near-dedup"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    extra = [words, [w + ("x" if i == 150 else "") for i, w in enumerate(words)], [w + ("x" if i in (20, 80, 140, 200, 260) else "") for i, w in enumerate(words)], rnd.sample(words, 300)]
    docs = docs.unionByName(spark.createDataFrame([(900_000 + i, " ".join(x)) for i, x in enumerate(extra)] + [(900_010, None), (900_011, ""), (None, "w1 w2")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    same_set, index = {}, {}
    for i, s in enumerate(sets):
        up[root(i)] = root(same_set.setdefault(s, i))
        if same_set[s] == i:
            for x in s:
                index.setdefault(x, []).append(i)
    for i in same_set.values():
        for j, n in Counter(j for x in sets[i] for j in index[x] if j < i).items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    same([tuple(r) for r in similar.classes(docs).collect()], [(doc, least[root(i)]) for i, (doc, _) in enumerate(rows)])
    assert Counter(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == Counter([*least.values(), None])


def test_op2(spark, folder, rows):
    want = []
    for doc, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = set()
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        n = len(words)
        want.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n))
    got = queries.op2_fertility(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    same([tuple(x)[:7] for x in got], want)
    assert all(not (x.base_failed and x.kept) for x in got) and sum(x.kept for x in got) > 0.5 * sum(not x.base_failed for x in got)


def test_fertility_bands_reject_junk_that_the_base_rules_pass(spark):
    sf = "/root/testdata/sf0.01"
    got = fertility.quality(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).filter("not base_failed")
    by = {r.quality: (r.n, r.kept) for r in got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert by[0][0] >= 10 and by[0][1] < 0.5 * by[0][0] and by[1][1] > 0.95 * by[1][0], by


def test_fertility_of_words_is_that_of_texts(spark):
    import public_tokenizers as P

    m = fertility.measure(P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))
    text = "the quick brown Füchse, jump over déjà vu 123"
    assert m.encode(" " + text) == [int(t) for w in text.encode().split() for t in __import__("numpy").frombuffer(m[w], "<i4")]


def test_op3(spark, folder, rows):
    train, docs = Counter(), []
    for doc, text, *_ in rows:
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
        tokens = [*WORD.findall(lower(text or "")), ""]
        docs.append((doc, held, tokens))
        if not held:
            train.update(tokens)
    n, v = sum(train.values()), len(train)
    got = queries.op3_ppm(spark, folder).collect()
    want = [(d, h, len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), 5)) for d, h, t in docs]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got], want)
    # against a trie that is walked symbol by symbol
    lm = Brute([t for _, held, t in docs if not held])
    want = {d: lm.text(t) for d, _, t in docs if d is not None and d >= 100_000}
    for r in got:
        if r.doc_id in want:
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-6), r.doc_id
    # held-out texts: well under three bits for a byte that order 0 gives over four
    size = {d: sum(len(w.encode()) + 1 for w in t) for d, h, t in docs if h}
    held = [r for r in got if r.held_out]
    assert held and -sum(r.score for r in held) / math.log10(2) < 3.6 * sum(size.values())


class Brute:
    """The same model, by dictionaries and symbol by symbol."""

    def __init__(self, texts):
        self.long, self.short = {}, {}
        for words in texts:
            for before, prefix, s in self.walk(words):
                if (ctx := self.top(before, prefix)) is not None:
                    self.long.setdefault(ctx, Counter())[s] += 1
                for k in range(3):
                    self.short.setdefault(before[len(before) - k :], Counter())[s] += 1
        met = {}
        for (kind, w), counts in self.long.items():
            t, d, once = sum(counts.values()), len(counts), sum(n == 1 for n in counts.values())
            if kind == "prefix" and len(w) >= 3 and t > 1:
                for kind, at, n in ((self.kind(t - 1, d - 1), 0, once), (self.kind(t - 1, d), 1, t - once)):
                    met.setdefault(kind, [0, 0])[at] += n
        self.see = ppm.escape_table([(k, *v) for k, v in met.items()])

    @staticmethod
    def kind(t, d):
        import numpy as np

        return int(ppm.kinds_of(np.array([t]), np.array([d]))[0])

    @staticmethod
    def walk(words):
        stream = b"   "
        for w in words:
            data = w.encode() + b" "
            for i in range(len(data)):
                yield stream[-3:], data[:i], data[i]
                stream += data[i : i + 1]

    @staticmethod
    def top(before, prefix):
        """The longest context: three bytes across the space, then the word's prefix."""
        return ("across", before) if len(prefix) < 2 else ("prefix", prefix) if len(prefix) <= ppm.DEPTH else None

    def text(self, words):
        total = 0.0
        for before, prefix, s in self.walk(words):
            ctx = self.top(before, prefix)
            longest = self.long.get(ctx)
            orders = ([longest] if longest else []) + [self.short[x] for x in (before[-2:], before[-1:], b"") if x in self.short]
            out = set()
            for counts in orders:
                left = {a: n for a, n in counts.items() if a not in out}
                t, d = sum(left.values()), len(left)
                e = self.see[self.kind(t, d)] if counts is longest and len(prefix) >= 3 else d / (2 * t) if t else 1
                if s in left:
                    total += math.log10((1 - e) * (2 * left[s] - 1) / (2 * t - d))
                    break
                if t:
                    total += math.log10(e)
                out |= set(left)
            else:
                total -= math.log10(256 - len(out))
        return total


def test_op3_depends_on_the_order_of_words(spark):
    rnd = random.Random(9)
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text]
    mixed = [(10**6 + r.doc_id, " ".join(rnd.sample(r.text.split(), len(r.text.split())))) for r in docs]
    both = spark.createDataFrame([tuple(r) for r in docs] + mixed, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score_texts(both).collect()}
    differ = sum(abs(got[r.doc_id] - got[10**6 + r.doc_id]) > 1e-6 for r in docs if len(set(r.text.split())) > 3)
    assert differ > 0.9 * sum(len(set(r.text.split())) > 3 for r in docs)


def test_op4(spark, folder, rows):
    want = []
    for doc, text, *_ in rows:
        text = text or ""
        found = []
        for order, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
                if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                    found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}", kind))
        joined = ",".join(x[2] for x in sorted(found))
        n = Counter(x[3] for x in found)
        want.append((doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()))
    got = queries.op4_pii(spark, folder).collect()
    same([tuple(r)[:6] for r in got], want)
    spans = " ".join(r.spans for r in got)
    assert "iban:" in spans and "ssn:" in spans


def test_checksums_and_mask():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.masked("é a@b.co x".encode()) == "é [EMAIL] x" and pii.masked(b"clean 12 text") == "clean 12 text"


def test_op5(spark, folder, rows):
    sizes = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows]
    per = Counter()
    for _, s, n in sizes:
        per[s] += n
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(per.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * per[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * per[s]
            left -= target[s]
            free.discard(s)
    got = queries.op5_mix(spark, folder).collect()
    same([(r.doc_id, r.size, r.source_size) for r in got], [(d, n, per[s]) for d, s, n in sizes])
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = Counter()
    for r in got:
        by[r.source_size, round(r.target, 4)] += r.taken
    assert set(by) == {(per[s], round(t, 4)) for s, t in target.items()}
    for s, t in target.items():
        block = max([mix.BLOCK >> i for i in range(7) if t >= (mix.BLOCK >> i) * mix.LEAST], default=1)
        assert abs(by[per[s], round(t, 4)] - t) <= 2.5 * block, (s, t)  # half a block of rounding, and a short last block in each round
    same(map(tuple, got), map(tuple, queries.op5_mix(spark, folder).collect()))


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * 15), f"s{i:02}") for i in range(20)] + [(100 + i, " ".join(["v"] * 50), "t") for i in range(100)]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    small = [r for r in got if r.doc_id < 100]
    assert all(abs(r.taken - r.target) <= 1 for r in small) and sum(r.taken for r in small) > 550
    assert abs(sum(r.taken for r in got) - 1.5 * 5300) <= 160


def test_quotas_are_those_of_a_priority_queue(spark):
    import heapq

    rnd = random.Random(12)
    shards, want = [], {}
    for source in range(12):
        n = rnd.choice([1, 2, 3, 7, 40])
        sizes = [rnd.choice([1, 5, 1000, 1000, rnd.randint(1, 200_000)]) for _ in range(n)]
        seats = rnd.randint(0, 400)
        shards += [(f"s{source}", i, w, seats) for i, w in enumerate(sizes)]
        held = [0] * n
        queue = [(-float(w), i) for i, w in enumerate(sizes)]
        heapq.heapify(queue)
        for _ in range(seats):
            _, i = heapq.heappop(queue)
            held[i] += 1
            heapq.heappush(queue, (-(sizes[i] / (2 * held[i] + 1)), i))
        want |= {(f"s{source}", i): q for i, q in enumerate(held)}
    got = mix.quotas(spark.createDataFrame(shards, "source string, shard long, shard_size long, seats long")).collect()
    assert {(r.source, r.shard): r.quota for r in got} == want


def test_taken_texts_hold_what_is_taken(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mix.mix(docs).agg(F.sum("taken")).first()[0]
    out = mix.taken_texts(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == plan


def test_op6(spark, folder, rows):
    first, texts = {}, [(r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()) for r in rows]
    for d, t in sorted(texts):
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            first[w] = min(first.get(w, (d, p)), (d, p))
    want = []
    for (d, t), r in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((r[0], len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    same([tuple(r) for r in queries.op6_suffix(spark, folder).collect()], want)


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(400):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 50))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchors_follow_content():
    rnd = random.Random(4)
    shared = bytes(rnd.choice(b"abcd ") for _ in range(300))
    for body in (shared, b"a" * 300):
        a, b = suffix.anchors(b"x" * 37 + body + b"y" * 50), suffix.anchors(body)
        at = {}
        for h, p, f, e in zip(*(c.tolist() for c in a), strict=True):
            at |= {w: (h, p - w) for w in range(f, e + 1)}
        for h, p, f, e in zip(*(c.tolist() for c in b), strict=True):
            for w in range(f, e + 1):
                assert at[w + 37] == (h, p - w)


def test_op7(spark, folder, rows):
    want = []
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        places = [(i, label) for phrase, label in license.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want.append((doc, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = queries.op7_license(spark, folder).collect()
    same([tuple(r)[:6] for r in got], want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_fuzzy_notices_are_found_as_by_plain_search():
    rnd = random.Random(6)
    found = license.notices()
    for i, (phrase, _, k) in enumerate(found.notices):
        for edits in range(k + 1):
            s = list(phrase)
            for _ in range(edits):
                s[rnd.randrange(len(s))] = rnd.choice("abcxyz")
            text = f"lorem ipsum {''.join(s)} dolor"
            assert regex.search(f"(?:{phrase}){{e<={k}}}", text) and i in {h[0] for h in found.hits(text)}, (phrase, text)


def brute_top(vectors, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in ok if c != q and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_op8(spark, folder, monkeypatch):
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    same([tuple(r) for r in queries.op8_kdtree(spark, folder).collect()], brute_top(vectors))
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "BLOCK", 5)
    same([tuple(r) for r in queries.op8_kdtree(spark, folder).collect()], brute_top(vectors))


def test_op8_counts_repeated_rows(spark, monkeypatch):
    rnd = random.Random(2)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    vectors += vectors + vectors[:50] + [(40, [0.9, -0.9, 0.5, 0.5]), (41, [0.9, -0.9, 0.5, 0.5])]
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    want = []
    for q in range(0, 200, 20):
        met = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for i, a in ints if i == q for c, b in ints if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(met)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    same([tuple(r) for r in kdtree.top_k(df).collect()], want)
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "BLOCK", 5)
    same([tuple(r) for r in kdtree.top_k(df).collect()], want)


def test_kdtree_prunes_exactly():
    import numpy as np

    rnd = np.random.default_rng(0)
    v = np.vstack([rnd.integers(-64, 64, (1500, 2)), [[5, 5]] * 40])
    ids = rnd.permutation(len(v))
    best, who = kdtree.Tree(ids, v).search(ids[:50], v[:50], np.full(50, kdtree.LOWEST + 1), 7)
    for i in range(50):
        want = sorted((-int(v[i] @ w), int(j)) for w, j in zip(v, ids, strict=True) if j != ids[i])[:7]
        assert list(zip((-best[i]).tolist(), who[i].tolist(), strict=True)) == want


def test_op9(spark, folder, rows):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = Counter()
    got = queries.op9_pack(spark, folder).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    for doc, text, *_ in rows:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        ids[(doc, len(want))] += 1
        for r in by_doc[doc, len(want)]:
            piece = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            if ids[(doc, len(want))] == 1 and doc not in (rows[1][0],):
                assert r.ids_crc32 == zlib.crc32(piece)
    assert {k: n * k[1] for k, n in ids.items()} == {k: sum(r.length for r in v) for k, v in by_doc.items()}


@pytest.mark.parametrize("text", ["don't <|endoftext|> x<|endoftext|>y", "a b c\x85d ́e", "İSTANBUL ΣΑΣ ﬁ 漢字　か 12.5", "tab\there\x0bvt\x0cff\rcr", "End, END. eND!? é. É, ́. x́. 漢。, a1. <|ENDOFTEXT|>. x<|endoftext|>a. it's, IT'S.", "a a\x00 a\x00\x00 ß ẞ SS × ÷ À÷ Ã\u0303 ungßlich ŸÿÞþ", "漢" * 40 + " " + "w" * 22 + " " + "w" * 23 + " " + "W" * 24 + "... " + "é" * 11 + "! " + "é" * 12 + "!", " ".join("x" * n + "#" * (n % 3) for n in range(1, 60))])
def test_words_tokenise_like_texts(text):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    want = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, n = pack.encode(raw, np.array([len(raw)]), path)
    assert ids.tolist() == want and n.tolist() == [len(want)]


def test_op10(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    data = {p: (h or "").encode() for p, h in pages}
    want = []
    for p, d in data.items():
        least = min(q for q, e in data.items() if e == d) if len(d) >= 100 else p
        want.append((p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if least != p else "response", least if least != p else None))
    got = queries.op10_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    same([tuple(r) for r in got], want)


def test_zip_is_read_as_by_zipfile(tmp_path):
    import zipfile

    data = b"".join(warc.zip_bytes([("a/b", [b"12", b"345"]), ("c", [])]))
    (tmp_path / "x.zip").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and z.read("a/b") == b"12345"
    read = lambda at, n: data[at : at + n]
    at, n = warc.zip_members(len(data), read)["a/b"]
    assert data[at : at + n] == b"12345"
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"payload")
    other = (tmp_path / "y.zip").read_bytes()
    at, n = warc.zip_members(len(other), lambda a, m: other[a : a + m])["big"]
    assert other[at : at + n] == b"payload"


def test_pipeline_stages(spark, folder, rows):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = queries.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    verdict = Counter((r.doc_id, r.n_words) for r in queries.op2_fertility(spark, folder).filter("kept").collect())
    assert Counter((r.doc_id, len(WORD.findall(r.text))) for r in kept.collect()) == verdict
    one = queries.drop_near_copies(spark, docs, folder)
    assert one.columns == docs.columns
    classes = {r.component_id for r in queries.op1_simhash(spark, folder).collect()}
    assert Counter(r.doc_id for r in one.collect() if r.doc_id is not None) == Counter(c for c in classes if c is not None)
    assert corpus_pipeline.run(spark, folder).count() > 0


CLASHES = ["rounds", "start", "phase", "rest", "blocks", "taken", "nth", "twin", "of", "size", "row", "none", "body", "clean", "c0", "c1", "_text", "_both", "_n", "name", "component_id", "at", "pid", "n", "ids", "mark", "shard", "kept", "a.b"]


@pytest.mark.parametrize("name", [n for n, _ in queries.STAGES])
def test_stages_keep_clashing_columns_and_do_without_optional_ones(spark, rows, name):
    """Extra columns named like inner ones, a map among them, come through; no lang and n_chars; nulls and repeats."""
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows[:60] + rows[-24:]], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES), F.create_map(F.lit("k"), F.col("doc_id")).alias("m")).repartition(3)
    out = dict(queries.STAGES)[name](spark, docs, "")
    if name == "packing":
        assert sum(r.length for r in out.collect()) > 0
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert got
    for r in got:
        shown = "?" if r.doc_id is None else str(r.doc_id)
        assert all(r[c] == f"{c}:{shown}" for c in CLASHES) and r["m"] == {"k": r.doc_id}
    plain = dict(queries.STAGES)[name](spark, docs.select("doc_id", "text", "source"), "").collect()
    twice = rows[1][0]  # has two texts, of which near-dedup keeps one by a hash of all columns
    same([(r.doc_id, r.text, r.source) for r in got if r.doc_id != twice], [tuple(r) for r in plain if r.doc_id != twice])


def test_scans_are_linear():
    import time

    for text, scan in (("1" * 1_000_000, pii.scan), ("1.1 " * 250_000, pii.scan), ("a@" * 500_000, pii.scan), ("cc by " * 170_000, license.scan), ("all rights reservd " * 50_000, license.scan)):
        began = time.process_time()
        scan(text.encode())
        assert time.process_time() - began < 6, text[:20]


def test_fuzzy_spans_edits_and_scores():
    """Substitutions, insertions and deletions: the place in words, the number of edits and the score."""
    phrase, label, k = license.notices().notices[2]
    for edited, edits in ((phrase, 0), (phrase.replace("apache", "apacbe"), 1), (phrase.replace("under", "undder"), 1), (phrase.replace("version", "versin"), 1), (phrase.replace("apache", "apche").replace(" license", " licence"), 2)):
        n, _, hits = license.scan(f"lorem ipsum dolor {edited} sit amet".encode())
        best = [h for h in hits if h["label"] == label]
        assert best and best[0]["errors"] == edits <= k
        assert best[0]["score"] == pytest.approx(1 - edits / len(phrase))
        assert (best[0]["first"], best[0]["last"]) == (3, n - 3)


def test_archives_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).repartition(2)
    written = warc.archive_pages(pages).cache()
    assert written.count() > 8
    read = warc.read_archives(written, task_bytes=8000)
    assert read.select(F.spark_partition_id()).distinct().count() > 3 and read.count() == 400
    data = b"".join(warc.zip_bytes([("x", [b"1"])]))
    bad = bytearray(data)
    bad[data.find(b"PK\1\2") + 10] = 8  # deflated
    with pytest.raises(ValueError, match="not stored"):
        warc.zip_members(len(bad), lambda a, n: bytes(bad[a : a + n]))
