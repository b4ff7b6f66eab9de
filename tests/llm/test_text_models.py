"""Language, toxicity and quality models: held-out accuracy, odd rows, and the small parts against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixedframe.llm import language
from mixedframe.llm.language import LanguageModel, held_out, ngrams, rejected
from mixedframe.llm.labels import training_labels
from mixedframe.llm.quality import STATISTICS, BoostedTrees, score_quality, statistics
from mixedframe.llm.toxicity import ToxicityModel, segments

ODD = [(9000, None), (9001, ""), (9002, " 12 34 !"), (9003, "é"), (None, "some text of the first kind ba be")]


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ba", "be", "bi"], "bb": ["ko", "ku", "ße"], "cc": ["漢", "字", "語"]}
    rows = [(i, sentences(rng, kinds[k], rng.randrange(5, 60)), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(i, t, None) for i, t in ODD] + [rows[0], (8000, "ba be bi " * 40_000, "aa")]
    return spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_language_of_every_document(spoken):
    docs = spoken.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    got = LanguageModel.fit(docs.where("NOT held_out")).predict(docs, drop=("text",)).collect()
    assert len(got) == spoken.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.lang)
    und = {r.doc_id: r.score for r in got if r.lang_pred == "und"}
    assert und == {9000: 0.0, 9001: 0.0, 9002: 0.0}
    assert all(0 <= r.score <= 1 for r in got)


def posterior(train, text):
    """Naive Bayes by its definition: log prior and summed log shares of the n-gram buckets."""
    import math
    from collections import Counter

    def grams(t):
        return Counter(int(k) for keys, _, _ in ngrams([t]) for k in keys)

    fits = {}
    for lang in {x for _, x in train}:
        own = [t for t, x in train if x == lang]
        counts = sum((grams(t) for t in own), Counter())
        total = sum(counts.values()) + language.ALPHA * (1 << language.BITS)
        fits[lang] = math.log(len(own) / len(train)) + sum(n * math.log((counts[k] + language.ALPHA) / total) for k, n in grams(text).items())
    best = max(sorted(fits), key=lambda x: fits[x])
    return best, 1 / sum(math.exp(f - fits[best]) for f in fits.values())


@pytest.mark.parametrize("block,at_once", [(256, 1 << 21), (2, 7), (1, 1 << 21)])
def test_language_is_the_naive_bayes_posterior(spark, monkeypatch, block, at_once):
    """Also with several blocks of languages and small slices of n-grams."""
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    rng = random.Random(6)
    kinds = {"a": "ab", "b": "abc", "c": "abd", "d": "abcd", "e": "bd"}
    train = [(sentences(rng, list(v), rng.randrange(1, 6)), k) for k, v in kinds.items() for _ in range(rng.randrange(2, 6))]
    asked = [sentences(rng, list("abcd"), n) for n in (1, 1, 2, 3, 8)] + ["a", "zz", "ab " * 400]
    learned = LanguageModel.fit(spark.createDataFrame(train, "text string, lang string"), block)
    got = learned.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(got, asked):
        lang, score = posterior(train, text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)
        assert r.text == text


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    got = LanguageModel.fit(docs).predict(docs).where(~rejected()).collect()
    assert got == []
    assert [r.lang_pred for r in LanguageModel.fit(docs).predict(docs).collect()] == ["und", "und"]


@pytest.mark.parametrize("piece", [8, 64, 1 << 18])
def test_ngrams_do_not_depend_on_where_texts_are_cut(monkeypatch, piece):
    rng = random.Random(3)
    texts = ["", None, "a", "漢字" * 30] + [sentences(rng, ["ab", "É", "z "], 20) for _ in range(20)]
    monkeypatch.setattr(language, "PIECE", piece)
    counts = [np.zeros(len(texts), int), np.zeros((len(texts), 1 << language.BITS), int)]
    for keys, owner, _ in ngrams(texts):
        np.add.at(counts[0], owner, 1)
        np.add.at(counts[1], (owner, keys), 1)
    sizes = [sum(max(0, len((t or "").lower()) - n) for n in range(3)) for t in texts]
    assert counts[0].tolist() == sizes
    for i, t in enumerate(texts):  # equal n-grams share a bucket
        grams = {(t or "").lower()[a : a + n] for n in (1, 2, 3) for a in range(len((t or "").lower()) - n + 1)}
        assert len(grams) - 3 <= (counts[1][i] > 0).sum() <= len(grams)


def best_segments(scores):
    """Ruzzo-Tompa by its definition: take the best segment, then go on left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    options = [(sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    _, _, _, a, b = max(options)
    return best_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in best_segments(scores[b:])]


def test_segments_match_their_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = np.where(rng.random(rng.integers(0, 14)) < 0.4, rng.integers(1, 6), -1.5 * rng.random() - 0.1).astype(float)
        assert [(a, b) for a, b, _ in segments(scores)] == best_segments(list(scores))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    bad = ["idiotic", "vileness", "scumbag", "trashy"]
    docs, labels = [], []
    for i in range(900):
        words = sentences(rng, ["ba", "ke", "lu", "mi"], rng.randrange(20, 80)).split()
        toxic, quality = int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            at = rng.randrange(len(words) - 6)
            words[at : at + 6] = [rng.choice(bad) if n % 2 == 0 else w for n, w in enumerate(words[at : at + 6])]
        text = " ".join(words) if quality else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        if i % 3:
            labels.append((i, quality, toxic, "x"))
    labels += [(5, None, None, "x"), (6, 7, 9, "x"), (None, 1, 1, "x"), (77_777, 1, 1, "x"), labels[0]]
    docs += [(i, t) for i, t in ODD] + [docs[3]]
    frame = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, y int, score string")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {i: (q, t) for i, q, t, _ in labels}


def test_toxic_passages(labelled):
    docs, labels, truth = labelled
    got = ToxicityModel.fit(docs, labels).score(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and truth[r.doc_id][1] is not None]
    assert len(held) > 80 and np.mean([(r.score >= 0.5) == truth[r.doc_id][1] for r in held if truth[r.doc_id][1] in (0, 1)]) > 0.97
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 900").collect()}
    for r in held:
        for p in r.passages:
            assert any(w in texts[r.doc_id].lower().replace("!", "").split()[p.first_word : p.after_word] for w in ("idiotic", "vileness", "scumbag", "trashy"))
    assert {r.doc_id for r in got if r.score >= 0.5}.isdisjoint({9000, 9001, 9002, 9003})


def test_quality_scores(labelled):
    docs, labels, truth = labelled
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and truth[r.doc_id][0] in (0, 1)]
    assert len(held) > 80 and np.mean([(r.score >= 0.3) == truth[r.doc_id][0] for r in held]) > 0.97


def test_models_without_labels_or_documents(spark, labelled):
    docs, labels, _ = labelled
    none = labels.where("false")
    assert {r.score for r in ToxicityModel.fit(docs, none).score(docs).collect()} == {0.0}
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    empty = docs.where("false")
    assert ToxicityModel.fit(empty, labels).score(empty).collect() == score_quality(empty, labels).collect() == []


def test_label_sample_is_bounded(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert 150 < training_labels(labels, "quality", 200).count() < 260
    assert training_labels(labels, "quality", 10**6).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(4000))


def test_statistics_of_known_texts():
    x = dict(zip(STATISTICS, statistics(pa.array(["Ab cd! cd\nAb cd! cd", None, "", "é1 |#"])).T))
    assert x["log_words"].tolist() == [np.log1p(6), 0, 0, np.log1p(2)]
    assert x["upper"][0] == 2 / 12 and x["exclamations"][0] == 2 / 6 and x["distinct_lines"][0] == 0.5 and x["line_words"][0] == 3
    assert x["distinct_words"][0] == 3 / 6 and x["commonest_word"][0] == 2 / 6
    assert x["digits"][3] == 1 / 5 and x["bars"][3] == x["symbols"][3] == 0.5 and x["non_ascii"][3] == 1
    assert all(v[1] == v[2] == 0 for v in x.values())


def test_flat_trees_give_what_walking_gives():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = BoostedTrees.fit(x, y, trees=40)
    fresh = rng.normal(size=(2000, 5))
    share = model.predict(fresh)
    assert np.mean((share > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] * fresh[:, 2] > 0))) > 0.9
    for i in range(20):
        margin = model.start
        for t in range(40):
            node = 0
            while node < 15:
                node = 2 * node + 1 + (fresh[i, model.statistic[t, node]] > model.threshold[t, node])
            margin += model.leaf[t, node - 15]
        assert share[i] == pytest.approx(1 / (1 + np.exp(-margin)))
