"""Toxicity fitted on all training rows, by brute force, and the verification of fuzzy lines."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import linededup, toxicity


def corpus(spark, n):
    r, rows = random.Random(8), []
    for k in range(n):
        bad = r.random() < 0.15
        words = [r.choice(["ba", "ke", "ti", "lo"])] + [w for w, p in (("idiot", 0.6), ("grolba", 0.5), ("scum", 0.3), ("hate", 0.2)) if r.random() < (p if bad else p / 20)]
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    return rows, docs, spark.createDataFrame([(k, y) for k, _, y in rows if k % 2], "doc_id bigint, toxic int")


def test_toxicity_is_fitted_on_all_training_rows(spark):
    rows, docs, labels = corpus(spark, 13_500)
    model = toxicity.fit(docs, labels)
    votes = np.zeros((len(rows), len(model.voters)))
    for k, text, _ in rows:
        votes[k, model.voters.fire(text)] = 1
    has, y = np.arange(len(rows)) % 2 == 1, np.array([float(y) for _, _, y in rows])
    q, _ = toxicity.label_model(votes, (votes[has], y[has]))
    x = np.concatenate((np.concatenate((votes[has], votes)), np.ones((len(q), 1))), axis=1)
    ridge, w = np.append(np.ones(votes.shape[1]), 1e-3), np.zeros(x.shape[1])
    for _ in range(30):  # no step of these overshoots
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - q) + ridge * w)
    assert np.abs(x.T @ (p - q) + ridge * w).max() < 1e-3
    assert np.allclose(model.weights / np.linalg.norm(model.weights), w[:-1] / np.linalg.norm(w[:-1]), atol=1e-5)
    z, own = (votes @ w[:-1])[has], (votes @ model.weights + model.bias)[has] >= 0

    def f1(found):
        return 2 * (found & (y[has] > 0)).sum() / (found.sum() + y[has].sum())

    assert f1(own) == max(f1(z >= cut - 1e-9) for cut in np.unique(z))


def test_sums_by_the_executors_give_the_same_scores(spark, monkeypatch):
    _, docs, labels = corpus(spark, 600)
    docs = docs.union(spark.createDataFrame([(None, "idiot"), (7, "twice"), (601, None)], docs.schema))
    here = toxicity.fitted_scores(docs, labels, trains="doc_id % 3 <> 0").orderBy("doc_id", F.desc("score")).collect()
    monkeypatch.setattr(toxicity, "LOCAL_CELLS", 0)
    model = toxicity.fit(docs, labels, trains="doc_id % 3 <> 0")
    there = toxicity.scored(docs, model).orderBy("doc_id", F.desc("score")).collect()
    assert len(here) == 603 and [x["doc_id"] for x in here] == [x["doc_id"] for x in there]
    assert np.allclose([x["score"] for x in here], [x["score"] for x in there], atol=1e-7)


def test_pairs_of_lines_are_dealt_before_they_are_verified(spark):
    both = spark.range(10).selectExpr("id as a", "id as b", "repeat('x', 50) as x", "repeat('y', 50) as y")
    plan = linededup._checked(both, 8, 0.85)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") < plan.index("Repartition")
