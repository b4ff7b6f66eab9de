"""The fits behind toxicity and quality, restated with plain loops."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mixedframe.llm import quality, toxicity
from mixedframe.llm.quality import BoostedTrees
from mixedframe.llm.toxicity import ToxicityModel, _buckets

BAD = ["idiotic", "vileness", "scumbag", "trashy"]


def corpus():
    rng = random.Random(8)
    docs, labels = [], {}
    for i in range(260):
        words = ["".join(rng.choices(["ba", "ke", "lu", "mi"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        labels[i] = int(rng.random() < 0.3)
        if labels[i]:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words)))
    return docs, labels


def forms_of(text):
    """For each word the buckets of its forms."""
    keys, _ = _buckets(pa.array([text]))
    return keys.tolist()


def best_segment(scores):
    best = run = 0.0
    for s in scores:
        run = max(0.0, run + s)
        best = max(best, run)
    return best


def test_toxicity_model_is_what_its_description_says(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = ToxicityModel.fit(frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    taught = [(t, labels[i]) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 0]
    counts = [{}, {}]
    for text, y in taught:
        for forms in forms_of(text):
            for b in forms:
                counts[y][b] = counts[y].get(b, 0) + 1
    total = [sum(c.values()) for c in counts]
    prior_total = toxicity.PRIOR_SHARE * sum(total)
    want = {}
    for b in counts[0].keys() | counts[1].keys():
        clean, toxic = counts[0].get(b, 0), counts[1].get(b, 0)
        prior = toxicity.PRIOR_SHARE * (clean + toxic)
        odds = [math.log((n + prior) / (total[y] + prior_total - n - prior)) for y, n in enumerate((clean, toxic))]
        value = odds[1] - odds[0] - toxicity.CAUTION * math.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        if value >= toxicity.LEAST:
            want[b] = min(value, toxicity.MOST)
    got = {int(b): float(model.table[b]) for b in np.flatnonzero(model.table)}
    assert got == pytest.approx(want) and len(got) >= 4

    def word_scores(text):
        return [max(want.get(b, 0.0) for b in forms) - toxicity.COST for forms in forms_of(text)]

    # the decay solves E[exp(lambda s)] = 1 over the words of clean documents, in bins of a quarter
    clean_words = [round((s + toxicity.COST) / toxicity.STEP) * toxicity.STEP - toxicity.COST for t, y in taught if y == 0 for s in word_scores(t)]
    mean = lambda x: sum(math.exp(x * s) for s in clean_words) / len(clean_words)
    if model.decay != 1.0:
        assert mean(model.decay) == pytest.approx(1, abs=1e-6) and mean(model.decay / 2) < 1
    else:
        assert max(clean_words) < 0
    excess = np.array([model.decay * best_segment(word_scores(t)) - math.log(max(len(forms_of(t)), 1)) for t, _ in taught])
    y = np.array([y for _, y in taught], float)
    assert model.log_k == pytest.approx(excess[y == 0].mean() - np.euler_gamma)
    # at the logistic fit the derivatives of its penalised log likelihood vanish
    x = excess - model.log_k
    p = 1 / (1 + np.exp(-(model.slope * x + model.offset)))
    assert abs((x * (p - y)).sum() + 1e-2 * model.slope) < 1e-3 and abs((p - y).sum()) < 1e-3
    scores = {r.doc_id: r.score for r in model.score(frame).collect()}
    for i, text in docs:
        e = model.decay * best_segment(word_scores(text)) - math.log(max(len(forms_of(text)), 1)) - model.log_k
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * e + model.offset))), abs=1e-9)


def grow(x, g, h, cuts, depth):
    """One complete tree by trying every cut of every statistic with plain masks: {node: (statistic, cut)}, node of each row."""
    splits, node = {}, np.zeros(len(g), int)
    for level in range(depth):
        for at in range((1 << level) - 1, (2 << level) - 1):
            rows = node == at
            best = (1e-6, None)
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                    if h[left].sum() < quality.LEAST_WEIGHT or h[right].sum() < quality.LEAST_WEIGHT:
                        continue
                    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.PENALTY)
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut))
            if best[1]:
                splits[at] = best[1]
        move = np.zeros(len(g), int)
        for at, (f, cut) in splits.items():
            own = node == at
            move[own] = x[own, f] > cut
        node = 2 * node + 1 + move
    return splits, node


def test_boosted_trees_equal_a_search_of_every_cut():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(220, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) ^ (rng.random(220) < 0.1)).astype(float)
    depth = 2
    model = BoostedTrees.fit(x, y, trees=4, depth=depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(3)]
    margin = np.full(220, math.log(y.mean() / (1 - y.mean())))
    assert model.start == pytest.approx(margin[0])
    for t in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        splits, node = grow(x, g, h, cuts, depth)
        for at in range((1 << depth) - 1):
            if at in splits:
                assert (model.statistic[t, at], model.threshold[t, at]) == pytest.approx(splits[at])
            else:
                assert model.threshold[t, at] == np.inf
        for leaf in range(1 << depth):
            own = node == leaf + (1 << depth) - 1
            assert model.leaf[t, leaf] == pytest.approx(-quality.RATE * g[own].sum() / (h[own].sum() + quality.PENALTY))
            margin[own] += model.leaf[t, leaf]
    assert model.predict(x) == pytest.approx(1 / (1 + np.exp(-margin)))
