"""Language-model scores against slow versions of their definition."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import sentences

from plumbline.llm import mixing, op2_mixing
from plumbline.llm.mixing import Code, Layout, Mixer, Records

ALL = (1 << 64) - 1


def held(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 == 2


def mix(x):
    x ^= x >> 33
    x = x * 0x9E3779B97F4A7C15 & ALL
    x ^= x >> 29
    x = x * 0xC2B2AE3D27D4EB4F & ALL
    return x ^ x >> 32


def slow_log10s(code, records):
    """Probabilities bit by bit, with the counts of each context in a dictionary; records: (symbol, held, near, one, two, more)."""
    paths = [[(int(x) >> 1, int(x) & 1) for x in code.path[a:b]] for a, b in zip(code.begin, code.begin[1:], strict=False)]
    contexts = lambda r: [("near", r[2]), ("one", r[3]), ("two", r[3], r[4]), ("four", r[3], r[4], r[5])]
    counts = defaultdict(lambda: [0, 0])
    learners = Counter(c for r in records if not r[1] for c in contexts(r))
    for r in records:
        for c in contexts(r):
            if not r[1]:
                for node, branch in paths[r[0]]:
                    counts[c, node][branch] += 1

    def order(r):
        """The hash by which equal records come together and are ordered."""
        k = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
        one = mix(r[3] + k[1] & ALL)
        two = mix(one + r[4] * k[2] & ALL)
        four = mix(two + r[5] * k[3] & ALL)
        out = mix(((mix(r[2] + k[0] & ALL) ^ r[0]) * k[1] & ALL) ^ one)
        for key, c in zip((one, two, four), contexts(r)[1:], strict=True):
            if learners[c] > (not r[1]):
                out ^= key
        return mix(out) >> 1 | r[1] << 63

    weights = [[w] * mixing.GATES for w in mixing.START_WEIGHTS]
    seen = [[0.0] * (mixing.GATES * mixing.MAP_STEPS) for _ in range(2)]
    groups = defaultdict(list)
    for i, r in enumerate(records):
        groups[order(r)].append(i)
    todo = sorted(groups)
    out, batches = [0.0] * len(records), 0
    level = lambda n: (n > 0.5) + (n > 1.5) + (n > 7.5)
    training = [g for g in todo if not g >> 63]
    steps = [training[a : a + mixing.BATCH] for a in range(0, len(training), mixing.BATCH)] + [todo[len(training) :]]
    for step in steps:
        bits = []
        for g in step:
            r, total = records[groups[g][0]], 0.0
            for node, branch in paths[r[0]]:
                odds, ns = [float(code.odds[node]), 0.3], []
                for c in contexts(r):
                    n = list(counts[c, node]) if (c, node) in counts and c != ("near", mixing.NONE) else [0, 0]
                    if not r[1]:
                        n[branch] = max(0, n[branch] - 1)
                    odds.append(max(-9, min(9, math.log((n[1] + mixing.CLOSE) / (n[0] + mixing.CLOSE)))))
                    ns.append(sum(n))
                gate = sum(level(n) * mixing.LEVELS**k for k, n in enumerate(ns[1:])) + (r[2] != mixing.NONE) * mixing.LEVELS**3
                mixed = max(-12, min(12, sum(w[gate] * x for w, x in zip(weights, odds, strict=True))))
                p = 1 / (1 + math.exp(-mixed))
                cell = gate * mixing.MAP_STEPS + round((mixed + 12) * (mixing.MAP_STEPS - 1) / 24)
                n0, n1 = seen[0][cell], seen[1][cell]
                q = (p + (n1 + mixing.MAP_PRIOR * p) / (n0 + n1 + mixing.MAP_PRIOR)) / 2
                total += math.log10(min(max(q if branch else 1 - q, mixing.LEAST_P), 1 - mixing.LEAST_P))
                bits.append((gate, odds, branch, p, cell, len(groups[g])))
            for i in groups[g]:
                out[i] = total
        if step and not step[0] >> 63:
            mass = [max(100, sum(m for gate, *_, m in bits if gate == k)) for k in range(mixing.GATES)]
            for gate, odds, branch, p, cell, m in bits:
                for w, x in zip(weights, odds, strict=True):
                    w[gate] += mixing.RATE / math.sqrt(1 + batches / 8) / mass[gate] * (branch - p) * m * x
                seen[branch][cell] += m
            batches += 1
    return out


def as_records(rows):
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    return Records(columns[0], columns[1].astype(bool), *columns[2:], np.arange(len(rows)))


def test_mixer_by_bits(monkeypatch):
    monkeypatch.setattr(mixing, "BATCH", 50)
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 23)  # no two contexts in a slot
    monkeypatch.setattr(mixing, "MOST_SLOTS", 24)
    rng = np.random.default_rng(3)
    text = [int(x) for x in rng.zipf(1.6, 700).clip(1, 40) - 1]
    text += text[100:250]  # a copy
    rows = [(s, int(i % 5 == 3), text[i - 1] % 4 if i else 9, *(text[i - k] if i >= k else 99 for k in (1, 2, 3))) for i, s in enumerate(text)]
    code = Code.over(np.bincount([r[0] for r in rows if not r[1]], minlength=40))
    got = Mixer(code).log10s(as_records(rows))
    assert np.allclose(got, slow_log10s(code, rows), rtol=1e-5, atol=1e-5)
    packed, sizes = Records.unpack([as_records(rows[:300]).pack(), as_records(rows[300:]).pack()])
    assert sizes.tolist() == [300, len(rows) - 300] and np.allclose(Mixer(code).log10s(packed), got)
    shuffled = rng.permutation(len(rows))
    assert np.allclose(Mixer(code).log10s(as_records([rows[i] for i in shuffled])), got[shuffled])


def test_mixer_where_cells_are_shared(monkeypatch):
    """Contexts whose cells others share are asked for in vain, or not at all where a wider one tells: the results are the same."""
    monkeypatch.setattr(mixing, "SEEN_BITS", 9)
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 23)
    monkeypatch.setattr(mixing, "MOST_SLOTS", 24)
    rng = np.random.default_rng(6)
    text = [int(x) for x in rng.zipf(1.4, 600).clip(1, 60) - 1]
    rows = [(s, int(i % 5 == 3), text[i - 1] % 4 if i % 3 else mixing.NONE, *(text[i - k] if i >= k else 99 for k in (1, 2, 3))) for i, s in enumerate(text)]
    code = Code.over(np.bincount([r[0] for r in rows if not r[1]], minlength=60))
    assert np.allclose(Mixer(code).log10s(as_records(rows)), slow_log10s(code, rows), rtol=1e-5, atol=1e-5)


def test_slots_of_training_records_are_hashed_once(monkeypatch):
    """For counting and for predicting: it is most of the work."""
    hashed, slots = [], mixing._slots
    monkeypatch.setattr(mixing, "_slots", lambda key, *a: hashed.append(len(key)) or slots(key, *a))
    rng = np.random.default_rng(7)
    text = rng.zipf(1.4, 9000).clip(1, 60) - 1
    rows = [(int(s), 0, int(text[i - 2]) % 4, *(int(text[i - k]) for k in (1, 2, 3))) for i, s in enumerate(text)]
    mixer = Mixer(Code.over(np.bincount(text, minlength=60)))
    mixer.log10s(as_records(rows))
    depth = np.diff(mixer.code.begin)[mixer.symbol]
    assert sum(hashed) == sum(int(depth[own].sum()) for own in mixer.asks) > 9000


def test_codes_tell_symbols_apart():
    for counts in ([5], [0, 0], [7, 1, 1, 3, 0, 9], list(range(300))):
        code = Code.over(np.array(counts))
        paths = [tuple(code.path[a:b].tolist()) for a, b in zip(code.begin, code.begin[1:], strict=False)]
        assert len(set(paths)) == len(counts) and all(paths)
        assert sum(2.0 ** -len(p) for p in paths) == (1 if len(counts) > 1 else 0.5)
        assert all(p[0] >> 1 == paths[0][0] >> 1 for p in paths)  # all from the root
    record, node, branch = code.decisions(np.array([3, 3, 250]))
    assert [tuple((node * 2 + branch)[record == k].tolist()) for k in range(3)] == [paths[3], paths[3], paths[250]]


def test_probabilities_of_all_symbols_add_up():
    rng = np.random.default_rng(4)
    rows = [(int(s), 0, 1, int(s) % 3, 5, 6) for s in rng.integers(0, 20, 400)]
    asked = [(s, 1, 1, 2, 5, 6) for s in range(20)]
    code = Code.over(np.bincount([r[0] for r in rows], minlength=20))
    got = Mixer(code).log10s(as_records(rows + asked))[len(rows) :]
    assert math.isclose((10**got).sum(), 1, rel_tol=1e-4)


def slow_scores(rows):
    """Base score and score of (id, text) rows."""
    texts = [(held(k), [*op2_mixing.tokens(t), b""]) for k, t in rows]
    c = Counter(w for h, t in texts if not h for w in t)
    listed = [b"", *sorted((w for w in c if w and c[w] > 1), key=lambda w: (-c[w], w))]
    place = {w: i for i, w in enumerate(listed)}
    total, escape = sum(c.values()), len(listed)
    cold = sorted({w for _, t in texts for w in t if w not in place})
    escaped = sum(c[w] for w in cold)
    code = Code.over(np.array([c[w] for w in listed] + [escaped]))
    number = lambda w: place[w] if w in place else 1 << 31 | xxhash.xxh64_intdigest(w) & (1 << 31) - 2
    records = []
    for h, t in texts:
        ids = [number(w) for w in t]
        for i, x in enumerate(ids):
            back = [ids[i - k] if i >= k else 0xFFFFFFFF for k in range(1, 5)]
            near = next((y for y in reversed(ids[: max(0, i - 1)]) if 0 < y < op2_mixing.FREQUENT), mixing.NONE)
            if 0 < back[0] < op2_mixing.FREQUENT:
                near = mixing.NONE  # it is the last one itself
            records.append((min(x, escape), int(h), near, back[0], back[1], mix(back[2] << 32 | back[3]) >> 48))
    spellings = []
    for w in cold:
        data = [*w, 32]
        for i, x in enumerate(data):
            b = [data[i - k] + 1 if i >= k else 0 for k in range(1, 7)]
            spellings.append((x, int(c[w] == 0), b[0], b[0] * 257 + b[1], b[2] * 257 + b[3], b[4] * 257 + b[5] & 0xFFFF))
    learned = np.bincount([r[0] for r in spellings if not r[1]], minlength=256)
    parts = iter(slow_log10s(Code.over(learned), spellings) if spellings else [])
    spelled = {w: 10 ** max(-300, sum(next(parts) for _ in range(len(w) + 1))) for w in cold}
    gate = 0.5 if escaped > 1 else 0.0
    for _ in range(op2_mixing.EM_ROUNDS if gate else 0):
        share = {w: gate * (c[w] - 1) / (escaped - 1) for w in cold if c[w]}
        gate = min(0.999, sum(c[w] * s / max(1e-300, s + (1 - gate) * spelled[w]) for w, s in share.items()) / escaped)
    bits = iter(slow_log10s(code, records))
    unit = math.log10(total + len([w for w in c if c[w]]) + 1)
    out = []
    for h, t in texts:
        score = sum(next(bits) for _ in t)
        for w in t:
            if w not in place:
                share = c[w] / max(1, escaped) if h else max(0, c[w] - 1) / max(1, escaped - 1)
                score += max(-300, math.log10(max(1e-300, gate * share + (1 - gate) * spelled[w])))
        out.append((len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(c[w] + 1) - unit for w in t), score, sum(map(len, t)) + len(t)))
    return out


def test_scores_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 20000]
    got = op2_mixing.score(docs.where("text IS NULL OR length(text) < 20000").coalesce(1)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(k, *x, held(k)) for (k, _), x in zip(rows, slow_scores(rows), strict=True)], key=key)
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["bits_per_byte"], r["held_out"]) for r in got], key=key)
    assert len(got) == len(want)
    assert math.isclose(sum(r[5] for r in got), sum(r[5] for r in want), rel_tol=3e-3)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[7] == b[7]
        assert math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=0.02, abs_tol=0.1)  # some contexts share a slot
        assert math.isclose(a[6], -a[5] / math.log10(2) / b[6], rel_tol=1e-9)


@pytest.mark.parametrize("size", [1 << 25, 5000])
def test_words_are_counted_in_packs(spark, docs, monkeypatch, size):
    """Counts of portions come together by bucket, whatever the buckets, each word in one."""
    monkeypatch.setattr(op2_mixing, "COUNTED_BYTES", size)
    rows = docs.select("doc_id", "text")
    c, n = Counter(), Counter()
    for k, t in rows.collect():
        words = [*op2_mixing.tokens(t), b""]
        n.update(words)
        c.update(words if not held(k) else [])
    got = op2_mixing.count_tokens(rows.repartition(3), 7, 2).collect()
    assert {r["word"]: (r["c"], r["n"]) for r in got} == {bytes(w): (c[w], n[w]) for w in n} and len(got) == len(n)
    assert op2_mixing.count_tokens(rows.where("false"), 7, 2).collect() == []


def test_distinct_numbers():
    ident = np.random.default_rng(8).integers(0, 50, 300).astype(np.uint64)
    first, inverse, many = mixing._distinct(ident)
    want = np.unique(ident, return_inverse=True, return_counts=True)
    assert (ident[first] == want[0]).all() and (inverse == want[1]).all() and (many == want[2]).all()


def test_cold_words_are_looked_up_in_packs(spark, monkeypatch):
    """A row for each block and bucket, not for each word; whatever the buckets, each word has its own count and spelling."""
    words = [f"w{i:04}".encode() + b"x" * (i % 7 * 20) for i in range(3000)]
    packed = [op2_mixing.pack_words(op2_mixing._brief(x, np.array([len(w) for w in x], np.int64))) for x in (words[:2000], words[1000:][::-1], [], words[5:6])]
    blocks = spark.createDataFrame(list(enumerate(packed)), "block long, cold binary")
    spelled = spark.createDataFrame([(w, i, -float(i)) for i, w in enumerate(words)], "word binary, c long, spelled float")
    for most in (0, 4000):
        monkeypatch.setattr(op2_mixing, "LOOKED_UP", 1000)
        got = op2_mixing.look_up(blocks, spelled, most).collect()
        assert len(got) <= 3 * (1 + most // 1000)
        found = {0: np.zeros(2000), 1: np.zeros(2000), 3: np.zeros(1)}
        for r in got:
            spellings = np.frombuffer(r["spellings"], "<f4")
            n = len(spellings)
            at, c = np.cumsum(mixing.unpack(r["places"], [(n, "<u4")])[0]), mixing.unpack(r["counts"], [(n, "<i8")])[0]
            assert (c == -spellings).all()
            found[r["block"]][at] += c
        assert (found[0] == np.arange(2000)).all() and (found[1] == np.arange(1000, 3000)[::-1]).all() and found[3] == 5


def test_held_out_texts_change_no_other_score(spark, docs):
    other = docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.concat(F.lit("quite other words "), F.reverse("text"))).otherwise(F.col("text")))
    scores = lambda df: sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in op2_mixing.score(df).where("NOT held_out AND doc_id IS NOT NULL").collect())
    a, b = scores(docs), scores(other)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-9)


def test_order_of_words_and_copies_matter(spark):
    rows = [(i, sentences(("en", "de")[i % 2], 300, i)) for i in range(40)]
    told = [i for i in range(1000, 1100) if held(i)][:3]
    words = rows[0][1].split()
    rows += [(told[0], rows[0][1]), (told[1], " ".join(words[::-1])), (told[2], sentences("en", 300, 777))]
    got = {r["doc_id"]: r["score"] for r in op2_mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not held(0) and got[told[0]] > 0.8 * got[told[1]] and got[told[0]] > 0.8 * got[told[2]]


def test_frequent_contexts_are_divided(spark):
    """No bucket holds much more than its size, whatever repeats; nothing is lost."""
    rng = np.random.default_rng(5)
    one = np.where(rng.random(40000) < 0.4, 7, rng.integers(0, 5000, 40000))
    two = np.where(rng.random(40000) < 0.5, 8, rng.integers(0, 5000, 40000))
    counts = np.stack([np.bincount(c, minlength=4096) for c in Layout.cells(one, two, 4096)])
    layout = Layout.of(counts, 1000)
    zeros = np.zeros(400, np.int64)
    found = [layout.buckets(Records(zeros, zeros > 0, zeros, one[a : a + 400], two[a : a + 400], zeros, zeros), a) for a in range(0, 40000, 400)]
    sizes = np.bincount(np.concatenate(found))
    assert sizes.max() <= 4000 and len(sizes) < 120
    rows = [(i, "a " * 3000 + sentences("en", 50, i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    got = op2_mixing.score(df, bucket=2000).collect()
    assert len(got) == 20 and all(r["n_tokens"] == 3051 and -3051 < r["score"] < 0 for r in got)


@pytest.mark.parametrize("keep", ["false", "doc_id = 1004", "doc_id IN (0, 7)"])
def test_few_rows(docs, keep):
    """No row, none to learn from, and hardly any."""
    rows = docs.where(keep)
    got = op2_mixing.score(rows).collect()
    assert len(got) == rows.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_frequent_long_tokens_are_listed(spark):
    ruler = "=" * 200
    got = op2_mixing.score(spark.createDataFrame([(i, f"{ruler} {i} {ruler}") for i in range(30)], "doc_id long, text string")).collect()
    assert all(r["n_known"] >= 3 - r["held_out"] and r["bits_per_byte"] < 1 for r in got)


def test_a_block_of_spellings_holds_narrow_numbers():
    """A block of spellings has a record a byte, millions in all: what a task holds of it and deals to buckets stays small."""
    import tracemalloc

    words = [f"word{i}".encode() for i in range(100_000)]
    data = b" ".join([*words, b""])
    body = np.array([len(data), len(words)], "<u8").tobytes() + mixing.pack([np.frombuffer(data, np.uint8), np.zeros(len(words), np.uint8)])
    layout = mixing.Layout.of(np.full((2, 1 << 12), 1000), 1 << 16)
    tracemalloc.start()
    try:
        records = op2_mixing.spelling_records(body)
        layout.buckets(records, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 * len(data)
