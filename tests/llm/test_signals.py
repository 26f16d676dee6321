"""Language identification and toxicity."""

import numpy as np
from pyspark.sql import functions as F
from texts import sentences

from plumbline.llm import op6_language, op7_toxicity


def test_language(spark, docs):
    net = op6_language.fit(docs)
    predict = op6_language.predictor(spark, net)
    rows = docs.select("doc_id", "text", "lang", predict("text").alias("p")).collect()
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert tuple(r["p"]) == ("und", 0.0)
        else:
            assert r["p"]["lang_pred"] in net.labels and 0 <= r["p"]["score"] <= 1
    told = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["p"]["lang_pred"] == r["lang"] for r in told]) > 0.9
    fresh = [op6_language.classify(net, [sentences(lang, 40, 99)])[0][0] == lang for lang in ("en", "de", "fr", "es")]
    assert all(fresh)


def test_whole_texts_count():
    net = op6_language.train(np.concatenate([op6_language.windows(sentences(lang, 400, s)) for lang in ("en", "de") for s in range(3)]), [x for lang in ("en", "de") for s in range(3) for x in [lang] * len(op6_language.windows(sentences(lang, 400, s)))])
    text = sentences("en", 60) + " " + sentences("de", 600)
    assert op6_language.classify(net, [text])[0][0] == "de"


def test_no_labels(spark, docs, none):
    assert op6_language.fit(none) is None
    assert op6_language.classify(None, ["text", None]) == [("und", 0.0)] * 2
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert op7_toxicity.fit(docs, labels, lambda c: F.lit(True)) is None
    got = docs.select(op7_toxicity.predictor(spark, None)("text").alias("p")).select("p.*").distinct().collect()
    assert [tuple(r) for r in got] == [(0.0, 0)]


def test_toxicity(spark):
    rows, marks = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        words = sentences(lang, 60, i).split()
        if i % 4 < 2:
            words[i % 60 : i % 60 + 1] = ["grobian", "lout"][i % 2 : i % 2 + 1]
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(i % 4 < 2)))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "x", "en")]
    marks += [(None, 1), (3, None), (2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    net = op7_toxicity.fit(docs, labels, lambda c: F.coalesce(c, F.lit(0)) % 5 != 0)
    got = docs.select("doc_id", op7_toxicity.predictor(spark, net)("text").alias("p")).collect()
    held = [(r["p"]["predicted"], int(r["doc_id"] % 4 < 2)) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["p"]["score"] <= 1 and r["p"]["predicted"] == (r["p"]["score"] >= 0.5) for r in got)
    # No language or other column is an input.
    again = docs.withColumn("lang", F.lit(None).cast("string"))
    assert [r["p"] for r in again.select(op7_toxicity.predictor(spark, net)("text").alias("p")).collect()] == [r["p"] for r in got]


def test_pairs_of_words_tell():
    """Words that are as frequent in either kind, but next to each other in toxic texts alone: only the wider filters can tell."""
    import random

    rng = random.Random(5)
    texts, marks = [], []
    for i in range(1200):
        words = sentences("en", 30, i).split()
        a, b = rng.sample(range(3, 27), 2)
        if i % 2:
            words[a : a + 1] = ["nasty", "creature"]
        else:
            words.insert(min(a, b), "nasty")
            words.insert(max(a, b) + 4, "creature")
        texts.append(" ".join(words))
        marks.append(i % 2)
    net = op7_toxicity.train(texts[:800], marks[:800], 0.5)
    got = op7_toxicity.scores(op7_toxicity._Words(net), texts[800:])
    assert np.mean([(g >= 0.5) == m for g, m in zip(got, marks[800:], strict=True)]) > 0.9
    # Without the wider filters it is a guess.
    narrow = op7_toxicity.WordNet(net.embedding, net.filters, net.bias, np.where(np.arange(len(net.out)) < op7_toxicity.FILTERS, net.out, 0), net.out_bias, net.thresholds)
    got = np.array(op7_toxicity.scores(op7_toxicity._Words(narrow), texts[800:]))
    assert abs(np.mean((got >= np.median(got)) == np.array(marks[800:])) - 0.5) < 0.15


def slow_toxicity(net, text):
    """Score of a text, word by word."""
    import math

    words = [op7_toxicity.word_ids(t) for t in text.lower().split()]
    rows = [sum(net.embedding[i].astype(float) for i in w) if w else np.zeros(op7_toxicity.DIM) for w in words] + [np.zeros(op7_toxicity.DIM)] * 3
    total, k = net.out_bias, 0
    for table in net.filters:
        for f in range(op7_toxicity.FILTERS):
            top = max(sum(rows[i + j] @ table[j, :, f] for j in range(len(table))) for i in range(len(words) + 1))
            total += max(0.0, top + net.bias[k]) * net.out[k]
            k += 1
    votes = {g: sum(t.strip(op7_toxicity._EDGES) in held.split() for t in text.lower().split()) for g, held in op7_toxicity.FUNCTION_WORDS.items()}
    group = max(votes, key=votes.get) if any(votes.values()) else "other"
    return 1 / (1 + math.exp(-(total - net.thresholds[group])))


def test_toxicity_by_brute_force():
    texts = [sentences(("en", "de")[i % 2], 40, i) + (" lout" if i % 4 < 2 else "") for i in range(200)]
    net = op7_toxicity.train(texts, [int(i % 4 < 2) for i in range(200)], 0.3)
    asked = [*texts[:20], "", "lout", "... lout! the", "the", "der lout und"]
    got = op7_toxicity.scores(op7_toxicity._Words(net), asked)
    assert np.allclose(got, [slow_toxicity(net, t) for t in asked], atol=1e-4)


def slow_language(net, text):
    """Label and probability of a text, window by window and filter by filter."""
    data = text.encode().lower()
    total = np.zeros(len(net.labels))
    for a in range(0, len(data), op6_language.WINDOW):
        cut = data[a : a + op6_language.WINDOW]
        x = list(cut) + [0] * (op6_language.WINDOW - len(cut))
        hidden = []
        for k, table in enumerate(net.filters):
            for f in range(op6_language.FILTERS):
                top = max(sum(table[j, x[i + j], f] for j in range(len(table))) for i in range(len(x) - len(table) + 1))
                hidden.append(max(0.0, top + net.bias[k * op6_language.FILTERS + f]))
        z = np.array(hidden) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(cut) / op6_language.WINDOW
    return net.labels[int(total.argmax())], total.max() / total.sum()


def test_language_by_brute_force():
    texts = [sentences(lang, 60, s) for s in range(5) for lang in ("en", "de", "fr")]
    cut = [op6_language.windows(t) for t in texts]
    net = op6_language.train(np.concatenate(cut), [("en", "de", "fr")[i % 3] for i, x in enumerate(cut) for _ in x])
    asked = [*texts[:4], "a", "der", sentences("fr", 25, 9)]
    for (label, score), (want, p) in zip(op6_language.classify(net, asked), (slow_language(net, t) for t in asked), strict=True):
        assert label == want and abs(score - p) < 1e-3


def test_letters():
    net = op6_language.train(op6_language.windows("text"), ["en"])
    texts = ["½", "²", "12 ½ ²!", "_", "ª", "日", "a", "Ⅳ", "٣"]
    assert [op6_language.classify(net, [t])[0][0] for t in texts] == ["und"] * 4 + ["en"] * 3 + ["und"] * 2


def test_samples_are_bounded(spark, monkeypatch):
    """Neither null nor repeated ids, nor equal rows, make a sample larger than its bound."""
    monkeypatch.setattr(op6_language, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(op7_toxicity, "SAMPLE_ROWS", 50)
    seen = []
    monkeypatch.setattr(op6_language, "train", lambda x, y, many: seen.append((len(x), set(y), len(set(map(bytes, x))))))
    monkeypatch.setattr(op7_toxicity, "train", lambda texts, marks, share: seen.append((len(texts), marks.count(1), len(set(texts)))))
    rows = [(None, f"a null id {i}", "en") for i in range(4000)] + [(i, f"ein text {i}", "de") for i in range(50)] + [(7, "the same", "fr")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    op6_language.fit(docs)
    assert seen.pop() == (50 + 50 + 1, {"en", "de", "fr"}, 101)
    rows = [(i % 2, f"text {i}") for i in range(6000)] + [(5, "equal")] * 2000 + [(i, f"more {i}") for i in range(100, 400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    op7_toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, lambda c: F.lit(True))
    n, toxic, distinct = seen.pop()
    assert n == distinct <= 100 and toxic <= 50


def test_toxicity_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert op7_toxicity.fit(none, labels, lambda c: F.lit(True)) is None
    net = op7_toxicity.fit(docs, labels, lambda c: F.lit(True))
    got = docs.select("doc_id", "text", op7_toxicity.predictor(spark, net)("text").alias("p")).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], tuple(r["p"])) == tuple(r["p"])  # repeated rows, repeated results


def test_toxicity_of_a_text_beside_others():
    """A text scores the same alone as before any other text."""
    texts = [sentences("en", 40, i) + (" lout" if i % 2 else "") for i in range(100)]
    words = op7_toxicity._Words(op7_toxicity.train(texts, [i % 2 for i in range(100)], 0.5))
    asked = ["", "lout", "the", "the river", *texts[:6]]
    alone = [op7_toxicity.scores(words, [t])[0] for t in asked]
    for other in ("lout lout", "the", "the quick river", ""):
        assert np.allclose(op7_toxicity.scores(words, [t for a in asked for t in (a, other)])[::2], alone, atol=1e-6)


def test_training_holds_one_table():
    """The driver trains beside all that it holds anyway: no second table of embeddings in double precision."""
    import tracemalloc

    texts = [sentences("en", 40, i) + (" lout" if i % 2 else "") for i in range(40)]
    tracemalloc.start()
    try:
        op7_toxicity.train(texts, [i % 2 for i in range(40)], 0.5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * 4 * op7_toxicity.BUCKETS * 2  # the table is 8 * 4 bytes a bucket
