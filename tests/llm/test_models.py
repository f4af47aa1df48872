"""Language identification and toxicity: slow versions, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.llm import language, queries, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], DOCS)


def slow_lengths(train, texts, order=language.ORDER):
    """{lang: [text]} -> per text {lang: bits}, walking from the longest context down at every byte."""
    seen = {lang: Counter() for lang in train}
    for lang, own in train.items():
        for text in own:
            data = language.normal_form(text)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    seen[lang][data[i - k : i + 1]] += 1
        for run, n in list(seen[lang].items()):
            if len(run) > language.ALWAYS and n < language.LEAST:
                del seen[lang][run]
    out = []
    for text in texts:
        data, bits = language.normal_form(text), {}
        for lang in train:
            after = {}
            for run, n in seen[lang].items():
                after.setdefault(run[:-1], []).append(n)
            total = 0.0
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    context = data[i - k : i]
                    if context not in after:
                        continue
                    weight = sum(after[context]) + len(after[context])
                    if data[i - k : i + 1] in seen[lang]:
                        total -= math.log2(seen[lang][data[i - k : i + 1]] / weight)
                        break
                    total -= math.log2(len(after[context]) / weight)
                else:
                    total += 8
            bits[lang] = total
        out.append(bits)
    return out


def test_code_lengths_match_a_walk_over_contexts(spark):
    train = {"aa": ["abra kadabra abra", "bra"], "bb": ["xyz xyyz zyx", "kxy ÄÖ x"], "cc": ["a"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in train.items() for t in own)]
    model = language.train(docs(spark, rows), F.lit(True))
    texts = ["abra", "xyz", "Äö!", "q", "kad xyz 12 zzz", "a" * 300]
    for text, expected in zip(texts, slow_lengths(train, texts)):
        found = np.frombuffer(language.normal_form(text), np.uint8)
        bits = model.lengths(language.runs(found, language.ORDER + 1)).sum(axis=0)
        assert bits == pytest.approx([expected[lang] for lang in model.langs])
        total = {lang: expected[lang] + p for lang, p in zip(model.langs, model.prior)}
        best = min(model.langs, key=total.get)
        score = 1 / sum(2.0 ** min(0.0, total[best] - b) for b in total.values())
        assert language.predict(model, [text])[0] == (best, pytest.approx(score))


def test_batches_do_not_change_predictions(spark, monkeypatch):
    rows = [(1, "abra kadabra", "aa"), (2, "xyz zyx", "bb")]
    model = language.train(docs(spark, rows), F.lit(True))
    texts = [None, "abra", "", "12 34", "xyz " * 50, "kad", " ", "½", "日本"]
    alone = [language.predict(model, [t])[0] for t in texts]
    assert language.predict(model, texts) == alone
    monkeypatch.setattr(language, "BYTES_AT_ONCE", 10)
    assert language.predict(model, texts) == alone
    assert [alone[i] for i in (0, 2, 3, 6, 7)] == [("und", 0.0)] * 5


def test_language_of_held_out_rows(spark):
    truth = {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op6_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == truth[r["doc_id"]]["lang"])
    assert np.mean(right) > 0.98


def test_language_of_odd_tables(spark):
    table = docs(spark, [(1, "abra", None), (2, None, "aa"), (None, "kad", "aa")]).withColumn("score", F.lit("clash"))
    none = language.train(table.where("doc_id = 1"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(table, none).collect()} == {"und"}
    model = language.train(table, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(table, model).collect()}
    assert got == {(1, "aa"), (2, "und"), (None, "aa")}
    assert language.identify(table.where("doc_id > 9"), model).count() == 0


def test_non_negative_risk_finds_hidden_positives():
    """Half of the unlabelled rows with the telling feature are hidden positives; they are not learned as clean."""
    rng = np.random.default_rng(0)
    rows, positive = [], []
    for _ in range(300):
        rows.append([0, *rng.integers(1, 40, 3).tolist()])
        positive.append(True)
    for i in range(1500):
        rows.append([*([0] if i % 5 == 0 else []), *rng.integers(1, 40, 3).tolist()])
        positive.append(False)
    weights, bias = toxicity.fit(rows, np.array(positive), 40, 0.2)
    chance = lambda row: 1 / (1 + np.exp(-(bias + weights[row].sum())))
    hidden = [chance(r) for r, p in zip(rows, positive) if not p and 0 in r]
    clean = [chance(r) for r in rows if 0 not in r]
    assert np.mean(np.array(hidden) > 0.5) > 0.95 and np.mean(np.array(clean) > 0.5) < 0.05


def test_toxicity_of_held_out_rows(spark):
    """On the larger table: the small one has six toxic rows among those held out."""
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, LARGER).collect()}
    assert len(got) == queries.table(spark, LARGER, "documents").count()
    toxic, clean = [], []
    for r in queries.table(spark, LARGER, "labels").collect():
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
        if row["held_out"]:
            (toxic if r["toxic"] else clean).append(row["score"])
    better = np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean])
    assert better > 0.95
    assert np.mean(np.array(toxic) >= 0.5) > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.02


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (4, 0), (5, 0)], "doc_id bigint, toxic int")
    rows = [(1, "bad word here", "x"), (2, "bad thing", "x"), (3, None, "x"), (4, "", "x"), (5, "fine", "x"), (None, "bad", "x")]
    table = docs(spark, rows).withColumn("positive", F.lit("clash"))
    model = toxicity.train(table, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4]
    without = toxicity.train(table, labels.where("toxic = 0"), F.lit(True))
    assert all(r["score"] < 0.5 for r in toxicity.score(table, without).collect())
    assert toxicity.score(table.where("doc_id > 9"), model).count() == 0


def test_scores_are_sums_over_distinct_features():
    model = toxicity.Model({f: 0.5 for f in toxicity.word_features("abcdefghij")}, -1.0)
    n = len(model.weights)
    expected = 1 / (1 + math.exp(1.0 - 0.5 * n))
    assert toxicity.Scorer(model).score("x ABCDEFGHIJ abcdefghij") == pytest.approx(expected)
    assert toxicity.text_features("x abcdefghij") >= set(model.weights)
