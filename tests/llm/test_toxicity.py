import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity
from tests.llm.conftest import shape


def maximal(scores):
    """All maximal segments by their definition: the best one, then the same on both sides."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0]:
                best = (total, i, j + 1)
    if best[0] <= 0:
        return []
    _, b, e = best
    left = maximal(scores[:b])
    right = [(x + e, y + e, s) for x, y, s in maximal(scores[e:])]
    return left + [(b, e, best[0])] + right


def test_segments_as_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice((-3, -1, 1, 2, 4)) + rng.random() / 100 for _ in range(rng.randrange(25))]
        found = toxicity.segments(np.array(scores))
        assert [x[:2] for x in found] == [x[:2] for x in maximal(scores)]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in maximal(scores)])


def test_scan_is_linear():
    import time

    def seconds(n):
        scores = np.where(np.arange(n) % 2, -1.0 - np.arange(n) / n, 1.0)
        began = time.process_time()
        toxicity.segments(scores)
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 60 * max(seconds(10_000), 1e-3)


@pytest.fixture(scope="module")
def learned(spark):
    """A model, and labelled texts whose toxic ones hold a passage of a few words."""
    rng = random.Random(3)
    plain = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    rows = []
    for i in range(600):
        words = plain(rng.randrange(20, 120))
        if i % 6 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vile", "rotten", "nasty", "vile!"], k=4)
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    return toxicity.fit(texts.filter("doc_id < 400")), texts


def test_held_out_passages_are_found(learned):
    model, texts = learned
    out = toxicity.scored(texts, model).join(texts, "doc_id").filter("doc_id >= 400").collect()
    assert np.mean([(r["score"] >= 0.3) == r["label"] for r in out]) > 0.97
    for r in out:
        if r["label"]:
            words = r["text"].split()
            found = [w for p in r["passages"] for w in words[p["begin"]:p["end"]]]
            assert {"vile", "rotten", "nasty", "vile!"} & set(found)


def test_odd_documents(learned, odd, clashing, none):
    model, _ = learned
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    out = toxicity.keep_clean(clashing, model, 0.5)
    assert shape(out, clashing) and out.count() == clashing.count()
    assert toxicity.scored(none, model).count() == 0


def test_models_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id bigint, text string, label int")
    assert toxicity.scored(odd, toxicity.fit(empty)).count() == odd.count()
    ones = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("label"))
    assert all(r["score"] > 0.5 for r in toxicity.scored(odd, toxicity.fit(ones)).collect())


def test_sample_of_labels(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (None, 1), (99, 1), (5, None)], "doc_id bigint, toxic int")
    rows = {r["doc_id"]: r["label"] for r in toxicity.labelled(odd, labels, "toxic").collect()}
    assert rows == {4: 1, 8: 0}
    assert toxicity.labelled(odd, labels, "toxic", rows=1).count() <= 1
