"""The trees of personal data learn from every document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragchew.llm import pii

WAYS = ["ann{0}@site{0}.org", "ann{0} (at) site{0} (dot) org", "ann{0}[at]site", "version {0}.{0}.{0}.{0}"]


@pytest.fixture(scope="module")
def docs(spark):  # more documents than any bound of a sample had
    pick = F.replace(F.element_at(F.array(*map(F.lit, WAYS)), (F.col("id") % 4 + 1).cast("int")), F.lit("{0}"), F.col("id").cast("string"))
    return spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Write to "), pick, F.lit(" today.")).alias("text")).localCheckpoint()


def spans_of(docs):
    o = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 30))
    for text, o in docs.select("text", o).collect():
        base = set(pii.base_spans(text))
        for kind, a, z in pii.proposals(text):
            yield o // 7 % 4 == 0, int((kind, a, z) in base or pii.is_personal(kind, text[a:z])), [kind, *pii.features(text, kind, a, z)]


def test_every_proposal_is_an_example(docs):
    want = list(spans_of(docs))
    got = pii.fit(docs, trees=2)
    y = np.array([label for held, label, _ in want if not held])
    assert got["prior"] == pytest.approx(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), abs=1e-12)
    x = np.array([row[1:] for held, _, row in want if not held])
    for c, v in zip(got["cuts"], x.T):
        assert list(c) == list(np.unique(np.quantile(v, np.linspace(0, 1, pii.BINS + 1)[1:-1], method="nearest")))
    assert len(got["trees"]) == 2


def test_first_tree_is_the_best_by_brute_force(docs):
    want = list(spans_of(docs))
    x = np.array([row[1:] for held, _, row in want if not held])
    y = np.array([label for held, label, _ in want if not held])
    got = pii.fit(docs, trees=1)
    model = pii.Boosted([], got["cuts"], got["prior"])
    (splits, leaves), = got["trees"]
    b, p = model.bins(x), 1 / (1 + np.exp(-got["prior"]))
    g, h = y - p, np.full(len(y), p * (1 - p))

    def won(side):
        return sum(g[s].sum() ** 2 / (h[s].sum() + 5.0) for s in (side, ~side))
    feature, cut = splits[0]
    best = max(won(b[:, j] <= c) for j in range(b.shape[1]) for c in range(pii.BINS + 1))
    assert won(b[:, feature[0]] <= cut[0]) == pytest.approx(best, rel=1e-4)
    node = pii.descend(b, splits)
    for k in range(len(leaves)):
        assert leaves[k] == pytest.approx(pii.RATE * g[node == k].sum() / (h[node == k].sum() + 5.0), abs=1e-4)


def test_thresholds_from_counts():
    counts = [(0, 16000, 90, 90), (0, 9000, 10, 6), (0, 8500, 100, 1), (2, 3000, 5, 5)]
    assert pii.thresholds(counts) == [9000 / pii.GRID, 2.0, 0.5, 2.0]
