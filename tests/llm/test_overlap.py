"""Decontamination, near-duplicates and the pipeline."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from texts import sentences

import corpus_pipeline
from plumbline.llm import near_copies, op4_decontamination, op10_simhash
from plumbline.llm.tokens import public

ITEMS = [(k, sentences(lang, n, 50 + k)) for k, (lang, n) in enumerate([("en", 40), ("de", 25), ("fr", 15), ("es", 6), ("en", 3), ("en", 30)])]


def benchmark(spark):
    return spark.createDataFrame([*ITEMS, (90, None), (91, ""), (None, "an item without any number of its own here")], "item_id long, text string")


def test_seeds_ignore_what_the_mask_ignores():
    words = op4_decontamination.Words().of([sentences("en", 30, 5)])[0]
    for mask in op4_decontamination.MASKS:
        other = words.copy()
        for j, on in enumerate(mask):
            if on == "0":
                other[7 + j] ^= np.uint64(12345678)
        assert op4_decontamination.seeds(words, mask)[7] == op4_decontamination.seeds(other, mask)[7]
        other[7] ^= np.uint64(99)
        assert op4_decontamination.seeds(words, mask)[7] != op4_decontamination.seeds(other, mask)[7]


def planted():
    rng, rows = random.Random(4), []
    for k, (item, text) in enumerate(ITEMS):
        words = text.split()
        around = lambda n, s: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
        rows.append((100 + k, f"{around(50, 1)} {text} {around(50, 2)}", item if len(words) >= 5 else None))
        changed = [w.upper() + "," for w in words]
        if len(words) >= 15:
            for j in range(4, len(words), 9):
                changed[j] = "changed"
        rows.append((200 + k, f"{around(9, 3)} {' '.join(changed)} {around(9, 4)}", item if len(words) >= 5 else None))
        rows.append((300 + k, " ".join(words[: len(words) // 4]) + " " + around(30, 5), None))
        rows.append((400 + k, around(200, 6), None))
    return [*rows, (500, None, None), (501, "", None), (None, ITEMS[0][1], 0), (100, rows[0][1], 0)]


def test_overlaps(spark):
    rows = planted()
    docs = spark.createDataFrame([(k, t, 7) for k, t, _ in rows], "doc_id long, text string, item_id int")
    found = {(r["doc_id"], r["item_id"]) for r in op4_decontamination.find(docs, benchmark(spark)).collect()}
    assert found == {(k, item) for k, _, item in rows if item is not None}
    kept = op4_decontamination.decontaminate(docs, benchmark(spark))
    assert kept.columns == docs.columns
    clean = [(k, t) for k, t, item in rows if item is None]
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((k, t or "") for k, t in clean)


def overlapping(item, text):
    index = op4_decontamination.Benchmark([(1, " ".join(item))])
    (own,) = op4_decontamination.Words().of([" ".join(text)])
    return index.overlaps(own)


def numbered(name, n):
    return [f"{name}{k}" for k in range(n)]


def test_long_items_leak_in_parts():
    """op4: a run of 13 words suffices in an item of any length; stretches between inserted words add up."""
    around = numbered("around", 40)
    for n, run in ((100, 49), (300, 140), (300, 13), (60, 13)):
        item = numbered("w", n)
        for start in (0, n // 3, n - run):
            assert overlapping(item, around + item[start : start + run] + around)[0][1] == run, (n, run, start)
    for n in range(18, 60):
        item = numbered("w", n)
        a, b = n // 3, 2 * n // 3
        assert overlapping(item, [*around, *item[:a], "put", *item[a:b], "in", *item[b:], *around]), n
        assert overlapping(item, around + item[:6] + around) == []
    item = numbered("w", 100)
    far = sum((item[k : k + 12] + around for k in range(0, 60, 12)), [])
    (found,) = overlapping(item, far)
    assert found[1:3] == (60, 60) and found[3:] == (0, 0)
    assert overlapping(item, far[: 3 * 52]) == []


def test_short_items_with_replaced_words():
    """op4: four fifths of a short item's words, wherever the others were replaced."""
    around = numbered("around", 20)
    for n in range(5, 18):
        item = numbered("w", n)
        for lost in [(j,) for j in range(n)] + [(j, k) for k in range(n) for j in range(k) if n >= 10]:
            text = ["other" if j in lost else w for j, w in enumerate(item)]
            for whole in (text, around + text + around):
                assert [f[1] for f in overlapping(item, whole)] == [n - len(lost)], (n, lost)
        less = max(-(-n // 2), min(-(-n * 4 // 5), 10)) - 1
        assert overlapping(item, around + item[:less] + around) == []
        if n >= 6:
            put = [*around, *item[: n // 2], "put", *item[n // 2 :], *around]
            assert overlapping(item, put), n
    item = numbered("w", 12)
    scattered = sum((item[k : k + 3] + around for k in range(0, 12, 3)), [])
    assert overlapping(item, scattered) == [] and overlapping(item, item[6:] + item[:6]) == []


def test_a_joined_benchmark_gives_the_same(spark, monkeypatch):
    """op4: the hash join of seeds finds what the search in a broadcast benchmark finds, and the same documents go."""
    docs = spark.createDataFrame([(k, t, k) for k, t, _ in planted()] + [(7, "same words " * 40, 1)], "doc_id long, text string, digest long")
    items = benchmark(spark).union(spark.createDataFrame([(8, "same words " * 10), (9, "other words " * 3 + sentences("en", 12, 9))], "item_id long, text string"))
    rows = lambda df: sorted(map(str, df.collect()))
    want, kept = rows(op4_decontamination.find(docs, items)), rows(op4_decontamination.decontaminate(docs, items))
    assert len(want) > 10 and op4_decontamination.small(items) is not None
    monkeypatch.setattr(op4_decontamination, "BLOCK_BYTES", 100)
    assert op4_decontamination.small(items) is None
    assert rows(op4_decontamination.find(docs, items)) == want
    assert rows(op4_decontamination.decontaminate(docs, items)) == kept
    assert op4_decontamination.find(docs.where("false"), items).count() == 0


def slow_long(item, text):
    """Equal words of the best stretch and of all stretches, over all ways to lay an item of 18 words or more on a text."""

    def best(equal):
        top = (0, 0, 0)
        for a in range(len(equal)):
            total = 0
            for b in range(a, len(equal)):
                total += 1 if equal[b] else -op4_decontamination.PENALTY
                top = max(top, (total, -b, -a))
        return top

    def stretches(equal, at):
        if sum(equal) < 6:
            return
        total, b, a = best(equal)
        a, b = -a, -b + 1
        matched = sum(equal[a:b])
        if total and matched >= 6:
            yield {at + j for j in range(a, b) if equal[j]}
            yield from stretches(equal[:a], at)
            yield from stretches(equal[b:], at + b)

    one, covered = 0, set()
    for shift in range(-len(item), len(text)):
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        for found in stretches([item[j] == text[j + shift] for j in range(a, b)], a):
            one, covered = max(one, len(found)), covered | found
    half = -(-len(item) // 2)
    return one >= max(min(half, 13), 10) or len(covered) >= max(half, 10)


def test_overlaps_by_an_exhaustive_aligner():
    """op4: seeds lose next to no overlap that laying every item on every place of a text finds, and add none."""
    rng = random.Random(11)
    found = missed = 0
    for trial in range(250):
        n = rng.randint(18, 40)
        item = [f"w{rng.randint(0, 60)}" for _ in range(n)]
        part = item[rng.randint(0, n // 3) : n - rng.randint(0, n // 3)]
        part = [w if rng.random() > 0.02 * (trial % 12) else f"x{rng.randint(0, 99)}" for w in part]
        text = [f"w{rng.randint(0, 60)}" for _ in range(15)] + part + [f"w{rng.randint(0, 60)}" for _ in range(15)]
        want, got = slow_long(item, text), bool(overlapping(item, text))
        assert want or not got
        found, missed = found + want, missed + (want and not got)
    assert found > 100 and missed <= 0.03 * found


def test_repetitive_texts_take_bounded_time_and_memory():
    """op4: equal words without end, in a text and in items, give what a short text of them gives."""
    import time
    import tracemalloc

    items = [(1, "a " * 400), (2, "b c " * 200), (3, "a " * 9), (4, "a b " * 5 + "c d e f g h i j k"), (5, sentences("en", 30, 3))]
    index = op4_decontamination.Benchmark(items)
    few = {x[0] for text in ("a " * 900, "b c " * 500) for x in index.overlaps(op4_decontamination.Words().of([text])[0])}
    (own,) = op4_decontamination.Words().of(["a " * 500_000 + items[4][1] + " b c" * 250_000])
    tracemalloc.start()
    began = time.time()
    got = index.overlaps(own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {x[0] for x in got} == few | {4} and few == {0, 1, 2}
    assert [x[1] for x in got if x[0] in (0, 1, 2, 4)] == [400, 400, 9, 30] or sorted((x[0], x[1]) for x in got) == [(0, 400), (1, 400), (2, 9), (4, 30)]
    assert peak < 1.5e9 and time.time() - began < 60


def test_listed_and_marked_places_are_the_same(monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randint(0, 2)}" for _ in range(n))) for k, n in enumerate((8, 12, 20, 40))]
    index = op4_decontamination.Benchmark(items)
    texts = op4_decontamination.Words().of([" ".join(f"w{rng.randint(0, 2)}" for _ in range(300)) for _ in range(10)])
    want = [sorted(index.overlaps(t)) for t in texts]
    assert sum(map(len, want)) > 10
    monkeypatch.setattr(op4_decontamination, "LISTED_PAIRS", 0)
    assert [sorted(index.overlaps(t)) for t in texts] == want
    monkeypatch.setattr(op4_decontamination, "MOST_PLACES", 0)
    alike = lambda rows: [[x[:2] for x in r] for r in rows]
    assert alike(sorted(index.overlaps(t)) for t in texts) == alike(want)


def test_nothing_to_compare(spark, docs, none):
    empty = benchmark(spark).where("false")
    assert op4_decontamination.find(docs, empty).count() == 0
    assert op4_decontamination.decontaminate(docs, empty).count() == docs.count()
    assert op4_decontamination.find(none, benchmark(spark)).count() == 0


# ---- near-duplicates --------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """component of each (id, fingerprint) row, all pairs."""
    ids = sorted({k for k, _ in rows if k is not None})
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    held = [(k, f) for k, f in rows if k is not None]
    for i, (a, f) in enumerate(held):
        for b, g in held[:i]:
            if (f ^ g).bit_count() <= 3 and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}


def test_fingerprints(docs):
    for key, text in docs.select("doc_id", "text").collect():
        assert op10_simhash.fingerprint((text or "").encode()) == slow_fingerprint(text), key


def test_components_by_brute_force(spark, docs):
    rows = op10_simhash.near_duplicates(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    expected = slow_components([(k, slow_fingerprint(t)) for k, t in texts])
    for r in rows:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]]


def fingerprints_near(centres, n, rng, reach):
    out = []
    for _ in range(n):
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, reach)):
            f ^= 1 << b
        out.append(f)
    return out


def test_links_of_crowded_halves(spark, monkeypatch):
    """Dense groups, compared in small blocks, connect just as all pairs do."""
    monkeypatch.setattr(op10_simhash, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(op10_simhash, "HOT_MEMBERS", 4)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    marks = sorted({*fingerprints_near(centres, 350, rng, 4), *(rng.getrandbits(64) for _ in range(50))})
    rng.shuffle(marks)
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(marks)], "node long, fp long")
    found = {r["node"]: r["root"] for r in op10_simhash.components(op10_simhash.links(nodes)).collect()}
    expected = slow_components(list(enumerate(marks)))
    assert {k: found.get(k, k) for k in range(len(marks))} == expected
    assert len(set(expected.values())) < 0.7 * len(marks)


def test_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in op10_simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, n + 1), 0), 101: 100}
    assert op10_simhash.components(edges.where("false")).count() == 0


def test_keep_one(spark, docs, none):
    kept = op10_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    component = slow_components([(k, slow_fingerprint(t)) for k, t in docs.select("doc_id", "text").collect()])
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in ids if k is not None) == sorted(set(component.values()))
    assert ids.count(None) == 1
    assert op10_simhash.near_duplicates(none).count() == 0 and op10_simhash.keep_one(none).count() == 0


def test_keep_one_of_odd_ids(spark):
    """A text stays though its id has another one that goes; rows without an id are compared like any others; the smallest id stays."""
    a, b, c = sentences("en", 30, 1), sentences("de", 30, 2), sentences("fr", 30, 3)
    rows = [(5, a, "x"), (3, a, "y"), (5, b, "z"), (None, c, "u"), (None, c, "v"), (None, a, "w"), (7, None, "p"), (8, "", "q")]
    kept = op10_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "row"] and got == sorted([("3", a), ("5", b), ("None", c), ("7", "")])


def slow_groups(rows):
    """group of each id: all pairs at an exact similarity of 0.8 of five-word shingles."""
    sets, parent = {}, {k: k for k, _ in rows}
    for k, text in rows:
        words = text.lower().split()
        sets[k] = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def copies(rng):
    """Near copies at many similarities, a chain, a crowd of copies of one text, and texts apart."""
    word, rows = lambda: f"w{rng.randint(0, 10**6)}", []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for n in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            other = list(base)
            for j in rng.sample(range(len(base)), n):
                other[j] = word()
            rows.append(" ".join(other))
    chain = [word() for _ in range(400)]
    rows += [" ".join(chain[k * 30 : k * 30 + 260]) for k in range(5)]
    crowd = [word() for _ in range(100)]
    for _ in range(90):
        other = list(crowd)
        for j in rng.sample(range(100), rng.choice((1, 2, 3))):
            other[j] = word()
        rows.append(" ".join(other))
    return list(enumerate([*rows, *(word() for _ in range(20)), "", "two words", "two words"]))


def test_near_copies_by_brute_force(spark, monkeypatch):
    for hot, block in ((32, 512), (3, 20)):
        monkeypatch.setattr(near_copies, "HOT_MEMBERS", hot)
        monkeypatch.setattr(near_copies, "BLOCK_MEMBERS", block)
        rows = copies(random.Random(hot))
        docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[3]], "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
        expected = slow_groups(rows)
        assert found.pop(None) == expected[0] and found == expected


def test_a_crowd_costs_some_pairs_a_text(spark, monkeypatch):
    """Texts that share most of their segments make HUBS pairs each at most, however many buckets they are in, and buckets are joined to what is known of them once."""
    rng, seen = random.Random(6), {}
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = [(k, " ".join(f"x{k}" if j == 5 + k % 140 else w for j, w in enumerate(base))) for k in range(120)]
    verified, write = near_copies._verified, near_copies.write_table

    def count(pairs, sets):
        seen["pairs"] = pairs.count()
        return verified(pairs, sets)

    def note(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(near_copies, "_verified", count)
    monkeypatch.setattr(near_copies, "write_table", note)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_copies.near_copies(docs).collect()} == {0}
    assert seen["pairs"] <= near_copies.HUBS * len(rows)
    assert sum(len(re.findall(r"Join Inner, \(key", seen[k])) for k in ("members", "shared")) == 1


def filed(sets, many):
    """The texts of each segment, as the search files them."""
    bits, bands = near_copies.segments(many)
    sims = [np.frombuffer(near_copies.simhash(s, near_copies.CHECK_BITS + bits * bands), np.uint8) for s in sets]
    for band in range(bands):
        rows = np.zeros(len(sets), near_copies._FILED)
        rows["check"] = [x[: near_copies.CHECK_BITS // 8].view("<u8") for x in sims]
        rows["segment"] = [int("".join(map(str, np.unpackbits(x[near_copies.CHECK_BITS // 8 :])[band * bits : (band + 1) * bits])), 2) for x in sims]
        rows["fp"] = np.arange(len(sets))
        yield rows


def test_simhash_finds_similar_sets():
    """Sets at a similarity of just 0.8 share a bucket of the SimHash search for any number of texts, unlike ones hardly do."""
    rng = np.random.default_rng(3)
    sets = []
    for n in [*range(8, 120), *range(200, 300, 10)]:
        own = rng.integers(0, 1 << 63, 10 * n, np.uint64)
        sets += [np.sort(own[:-n]), np.sort(own[n:])]  # 8n of 10n in common
    assert all(near_copies.similar(sets[k], sets[k + 1]) for k in range(0, len(sets), 2))
    for many in (100, 1 << 18, 1 << 24):
        found, strange = set(), 0
        for rows in filed(sets, many):
            keys, fp = near_copies.buckets(rows)
            for key in set(keys.tolist()):
                held = fp[keys == key].tolist()
                found |= {a for a in held if a % 2 == 0 and a + 1 in held}
                strange += len({a // 2 for a in held}) > 1
        assert len(found) == len(sets) // 2 and strange <= 2


def test_simhash_bits():
    """Each bit is the majority of the set's hashes drawn out; more bits begin with the same ones; sets are counted in whole."""
    own = np.random.default_rng(4).integers(0, 1 << 63, 700, np.uint64)
    bits = np.unpackbits(np.frombuffer(near_copies.simhash(own, 1000), np.uint8))
    each = [np.unpackbits(np.frombuffer(near_copies.simhash(own[k : k + 1], 1000), np.uint8)) for k in range(len(own))]
    assert (bits == (2 * np.sum(each, 0, dtype=int) > len(own))).all() and 0.4 < bits.mean() < 0.6
    assert near_copies.simhash(own, 1000)[:16] == near_copies.simhash(own, 128)
    assert not any(near_copies.simhash(own[:0], 128))


def test_crowds_are_searched_in_waves(monkeypatch):
    """A crowded segment gives the same buckets as pair by pair."""
    rng = random.Random(8)
    marks = fingerprints_near([rng.getrandbits(64) for _ in range(5)], 400, rng, 12) + [rng.getrandbits(64) for _ in range(60)]
    rows = np.zeros(len(marks), near_copies._FILED)
    rows["check"] = np.array([[m, m ^ 0x5555] for m in marks], np.uint64)
    rows["fp"] = range(len(marks))
    whole = [x.tolist() for x in near_copies.buckets(rows)]
    monkeypatch.setattr(near_copies, "CROWD", 10)
    assert sorted(zip(*[x.tolist() for x in near_copies.buckets(rows)], strict=True)) == sorted(zip(*whole, strict=True))
    near = [(a, b) for a in range(len(marks)) for b in range(a) if 2 * (marks[a] ^ marks[b]).bit_count() <= near_copies.RADIUS]
    key = dict(zip(whole[1], whole[0], strict=True))
    assert near and all(key[a] == key[b] for a, b in near)
    assert near_copies.buckets(rows[:0])[0].size == 0


def test_near_duplicate_stage(spark):
    """A copy with one word in 60 replaced goes though its fingerprint is far away."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(k, " ".join("other" if j % 60 == 30 + k and k else w for j, w in enumerate(base))) for k in range(6)]
    assert all((op10_simhash.fingerprint(rows[0][1].encode()) ^ op10_simhash.fingerprint(t.encode())).bit_count() > 3 for _, t in rows[1:])
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_sets_are_made_by_one_function(spark, docs):
    """A stage with two Python functions would keep twice the workers in an executor."""
    base = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    fps = {k: xxhash.xxh64_intdigest(near_copies.shingles((t or "").encode()).tobytes()) for k, t in base.collect()}
    wanted = [(k, fps[k] - (1 << 64) if fps[k] >> 63 else fps[k]) for k in (0, 5, 1004)]
    sets = near_copies._sets(base, spark.createDataFrame(wanted, "node long, fp long"))
    assert sorted(r["fp"] for r in sets.collect()) == sorted(fp for _, fp in wanted)
    plan = sets._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"MapInArrow|ArrowEvalPython", plan)) == 1


def test_near_copies_of_nothing(none):
    assert near_copies.near_copies(none).count() == 0


# ---- the pipeline -----------------------------------------------------------------------


def test_pipeline(spark, tmp_path, docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    source = docs.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(5000).cast("long")))
    leak = docs.where("doc_id = 8").first()["text"]
    for name, df in (("documents", source), ("labels", labels), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf, current, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == current.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        current = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen.append({r[0] for r in current.select("doc_id").collect()})
    assert {1000, 1001, 1002, 1003} & seen[0] == set() and {0, 5, 5000, 1004} <= seen[0]
    assert seen[1] == seen[0]  # no toxic label, nothing is rejected
    assert 5000 not in seen[2] and 5 in seen[2]
    assert 8 not in seen[3] and 5 in seen[3]
    run = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(str, run.select(columns).collect())) == sorted(map(str, current.select(columns).collect()))


def test_pipeline_of_nothing(spark, tmp_path, none):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert public("word_bpe_49k.json")
