"""Tokenizing and both packings."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from plumbline.llm import op1_tokens, op3_packing
from plumbline.llm.tokens import byte_bpe, public, public_pattern, word_bpe

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
TRICKY = [
    "don't it's, word'. “hi…”. x|y.. É. é, 12.5, á. <|endoftext|> ÀB,, ñ?!", "", " \n ", "a" * 5000, "日本語、テスト。 ok", "A.B, 'tis 'S x'S. (y) ---", "3rd. ½, Ⅳ. x\x1cy z\x85.",
    "é. ́, x​.", "tab\tnew\x0bline\x0cfeed",
]


def test_word_ids_equal_the_plain_call():
    plain = Tokenizer.from_file(public(WORD))
    bpe = word_bpe(public(WORD))
    for _ in range(2):  # empty cache, then filled
        ids, cuts = bpe.encode(pa.array(TRICKY))
        for text, a, b in zip(TRICKY, cuts, cuts[1:], strict=False):
            assert plain.encode(text, add_special_tokens=False).ids == ids[a:b].tolist()


def one_by_one(lengths, size):
    """The rule of best-two-fit, row by row."""
    left, rows = Counter(lengths), []

    def take(x):
        left[x] -= 1
        if not left[x]:
            del left[x]

    while left:
        row, gap = [], size
        while fits := [x for x in left if x <= gap]:
            row.append(max(fits))
            gap -= row[-1]
            take(row[-1])
        if gap:
            small = min(row)
            pairs = [(a + b, a, b) for a in left for b in left if b <= a and a + b <= gap + small and (a != b or left[a] > 1)]
            if pairs and max(pairs)[0] > small:
                _, a, b = max(pairs)
                row.remove(small)
                left[small] += 1
                for x in (a, b):
                    take(x)
                    row.append(x)
        rows.append(tuple(sorted(row)))
    return sorted(rows)


def test_plan_equals_one_by_one_packing():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.randint(4, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 90))]
        kinds = op3_packing.plan(np.bincount(lengths, minlength=size + 1), size)
        mine = sorted(tuple(sorted(x for length, n in kind for x in [length] * n)) for times, kind in kinds for _ in range(times))
        assert mine == one_by_one(lengths, size)


def test_pack(spark, docs):
    got = op3_packing.pack(docs, public(WORD), 256).toPandas()
    plain = word_bpe(public(WORD))
    rows = docs.select("doc_id", "text").toPandas()
    total = 0
    for key, text in rows.itertuples(index=False):
        whole = np.array([*plain.encode(pa.array([text or ""]))[0], 0], "<u4")
        total += len(whole)
        own = got[got.doc_id.isna()] if key != key or key is None else got[got.doc_id == key]
        for k, a in enumerate(range(0, len(whole), 256)):
            piece = own[own.piece == k]
            assert set(piece.start) == {a} and set(piece.length) == {len(whole[a : a + 256])}
            assert set(piece.ids_crc32) == {zlib.crc32(whole[a : a + 256].tobytes())}
    assert got.length.sum() == total
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    assert got.sequence_id.nunique() <= -(-total // 256) + 1


def test_pack_of_nothing(none):
    assert op3_packing.pack(none, public(WORD)).count() == 0
    assert op1_tokens.pack(none, public(BYTE), public_pattern()).count() == 0


def test_capacity_tree():
    rng, size = random.Random(1), 37
    tree, free = op1_tokens.CapacityTree(size), Counter()
    for k in range(2000):
        if rng.random() < 0.5:
            f = rng.randint(0, size)
            tree.add(f, k)
            free[f] += 1
        else:
            need = rng.randint(0, size)
            fits = [f for f, n in free.items() if n and f >= need]
            found = tree.take(need)
            assert (found is None) == (not fits)
            if found:
                assert found[0] == min(fits)
                free[found[0]] -= 1


def test_id_matrices_round_trip(docs):
    size = 128
    rows = op1_tokens.pack(docs, public(BYTE), public_pattern(), size).collect()
    bpe = byte_bpe(public(BYTE), public_pattern())
    pieces, filled = {}, 0
    for r in rows:
        ids, place = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(place) == size and r["cu_seqlens"][-1] == r["n_tokens"] <= size
        filled += r["n_tokens"]
        for key, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert place[a:b].tolist() == list(range(b - a))
            pieces.setdefault((key, piece), []).append(ids[a:b].tolist())
    for key, text in docs.select("doc_id", "text").collect():
        own = [x for k in range(10_000) if (key, k) in pieces for x in pieces[key, k][:1]]
        flat = [i for x in own for i in x]
        assert flat[-1] == bpe.end and bpe.inner.decode(flat[:-1]) == (text or "")
    assert len({r["sequence_id"] for r in rows}) == len(rows) <= -(-filled // size) + 4


def test_long_white_space_is_lossless():
    bpe = byte_bpe(public(BYTE), public_pattern())
    for text in ("a" + "\n" * 1_000_000 + "b", " " * 25_000, "x" * 300_000, "!?" * 200_000):
        assert bpe.inner.decode(bpe.encode(text).tolist()) == text


def test_words_are_kept_in_bounds_and_go_when_idle(monkeypatch):
    """Few words at a time and in all, the same ids; a worker without texts keeps none."""
    import time

    from plumbline.llm import tokens

    texts = pa.array([f"{sentence} word{k} again{k // 2}, tail{k % 7}!" for k, sentence in enumerate(["the river", "der fluss", "la rivière"] * 40)])
    ids, cuts = tokens.WordBpe(public(WORD)).encode(texts)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    monkeypatch.setattr(tokens, "BATCH_WORDS", 7)
    monkeypatch.setattr(tokens, "IDLE_S", 0.3)
    bpe = tokens.WordBpe(public(WORD))
    got = [bpe.encode(texts.slice(k, 10)) for k in range(0, len(texts), 10)]
    assert np.concatenate([g[0] for g in got]).tolist() == ids.tolist() and len(bpe.known) + len(bpe.older) <= 60 + 2 * 60
    time.sleep(1)
    assert len(bpe.known) == 1 and not bpe.older
    again = bpe.encode(texts)
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == cuts.tolist() and len(bpe.known) > 1
