"""The two trained models: exact counts, normalised probabilities, marginals by enumeration, held-out accuracy, edge cases."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np

from swathkit.llm import lm, queries, toxicity


def test_language_model_on_the_table(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(t for i, x in texts.items() if not held(i) for t in lm.tokens(x))
    total, distinct = sum(count.values()), len(count)
    rows = queries.op8_lm_scoring(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = lm.tokens(texts[r["doc_id"]])
        base = sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(t in count for t in own), total)
        assert math.isclose(base, r["base_score"], rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_equal_a_slow_softmax(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 30)), p=[0.02] * 40 + [0.2 / 60] * 60))) for k in range(150)] + [(900, "never seen words here"), (901, ""), (902, None)]
    made = {}
    keep = lambda name, f: monkeypatch.setattr(lm, name, lambda *a, **b: made.setdefault(name, []).append(f(*a, **b)) or made[name][-1])
    keep("train_round", lm.train_round)
    keep("learn_counts", lm.learn_counts)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    model, (vocabulary, _) = made["train_round"][-1], made["learn_counts"][0]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(t for i, x in rows if not held(i) for t in lm.tokens(x))
    a, b, q, bias = (model[k].astype(np.float64) for k in "ABQb")
    symbol = lambda t: int(vocabulary.look_up([t])[1][0])
    low = lm.SYMBOLS - lm.BUCKETS
    mass = Counter()
    for t, c in count.items():
        if symbol(t) >= low:
            mass[symbol(t)] += c + 1
    for i, text in rows[::7] + rows[-3:]:
        u = v = 0
        want = 0.0
        for t in lm.tokens(text):
            w = symbol(t)
            logits = a[v] @ q.T + b[u] @ q.T + bias[:, 0]
            want += (logits[w] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if w >= low:
                want += math.log10(count[t] + 1) - math.log10(mass[w] + 1)
            u, v = v, w
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-3), (i, got[i], want)


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    share = rng.random(lm.SYMBOLS)
    model = lm.start_model(share / share.sum())
    one, two, b, z = lm.log_tables(model)
    for u, v in ((0, 0), (3, 9), (2000, 7)):
        assert abs(np.exp((one[v] + two[u] + b - z[v, u]).astype(np.float64)).sum() - 1) < 1e-3


def test_language_model_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 30_000), (None, "a"), (4, "new words"), (4, "new words")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3, 60_001] and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 1, 5])
    x, jump = rng.normal(size=9) * 2, rng.normal(size=(2, 2))
    got, start = toxicity.forward_backward(x, lengths, jump), 0
    for n in lengths:
        own, weight = x[start : start + n], np.zeros((n, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(own[k] * s for k, s in enumerate(states)) + sum(jump[a, b] for a, b in zip(states, states[1:])))
            for k, s in enumerate(states):
                weight[k, s] += w
        if n:
            assert np.allclose(got[start : start + n], weight[:, 1] / weight.sum(1))
        start += n


def test_toxicity_on_the_table(spark):
    data = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, data).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    toxic, clean = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above > 0.9 and sum((s >= 0.5) == y for s, y in out) / len(out) > 0.9


def test_spans_and_edges(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"fine{chr(97 + k)}" for k in range(20)], ["gruk", "blarg", "snork"]
    rows = []
    for k in range(400):
        words = list(rng.choice(good, 30))
        if k % 2:
            words[int(rng.integers(30))] = str(rng.choice(bad))
        rows.append((k, " ".join(words), k % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "finea " * 50_000 + "gruk"), (None, "blarg finea")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2000, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, field).collect()}
    assert [(s["start"], s["end"]) for s in got[1002]["toxic_spans"]] == [(300_000, 300_004)]
    assert got[1000]["toxicity"] < 0.5 and got[1001]["toxicity"] < 0.5 and got[None]["toxicity"] >= 0.5
    assert sum((got[i]["toxicity"] >= 0.5) == y for i, _, y in rows) >= 390
    kept = {r["doc_id"] for r in toxicity.reject(docs, labels).collect()}
    assert {1000, 1001} <= kept and None not in kept
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0
    one = labels.where("toxic = 0")
    assert toxicity.score(docs, one).where("predicted = 1").count() == 0


def test_sample_of_repeated_ids(spark):
    rows = [(1, "zz long text of one")] * 2000 + [(1, "b"), (1, "a"), (2, None), (3, "three"), (3, "three"), (None, "none"), (4, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (5, 1)], "doc_id long, toxic int")
    for _ in range(2):
        texts, toxic = toxicity.labelled_sample(docs, labels, ~toxicity.is_held_out(10**6))
        assert sorted(zip(texts, toxic)) == [("", 0), ("a", 1), ("three", 0)]
    small, _ = toxicity.labelled_sample(docs, labels, ~toxicity.is_held_out(10**6), sample_bytes=1)
    assert sum(map(len, small)) <= 1
