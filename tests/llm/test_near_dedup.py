import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import darts, near_dedup
from tests.llm.conftest import shape


def shingles(text):
    words = text.split()
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def likeness(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """Class of each doc_id by all pairs."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    made = [(d, t, shingles(t)) for d, t in rows if d is not None and t is not None]
    for i, (d, t, s) in enumerate(made):
        for e, u, r in made[:i]:
            if t == u or (s and r and likeness(s, r) >= 0.8):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) if d in root else d for d, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies, chains, exact copies, and texts that share a long passage but are not alike."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for size in (2, 3, 40):
        base = fresh(300)
        texts += [edited(rng, base, rng.choice((1, 2, 5, 9))) for _ in range(size)]
    chain = fresh(250)
    for _ in range(12):  # each is like the next, the ends are not alike
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 4).split()
    passage = fresh(150)
    texts += [" ".join(passage + fresh(100)) for _ in range(40)]
    texts += [texts[0]] * 7 + ["short one"] * 3 + [" ".join(fresh(60)) for _ in range(30)]
    rng.shuffle(texts)
    return spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_classes_as_by_all_pairs(copies, odd, clashing, docs):
    for df in (copies, docs, odd, clashing):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        found = near_dedup.classes(df).collect()
        assert len(found) == len(rows)
        assert {r["doc_id"]: r["class_id"] for r in found} == brute(rows)


def test_repeated_rows_reach_the_second_step(spark, monkeypatch):
    """One bucket, whose leader is like none of its members: all links are found among the rarest shingles."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lead, x, y, long = " ".join(fresh(80)), fresh(100), fresh(90), " ".join(fresh(400))
    rows = [(1, lead), (2, " ".join(x)), (2, " ".join(x)), (2, " ".join(x)), (3, edited(rng, x, 1))]
    rows += [(4, " ".join(y)), (4, long), (5, edited(rng, y, 1)), (6, long + " more")]  # 4 ties 5 and 6
    rows += [(7, " ".join(fresh(100))), (7, " ".join(fresh(100)))]
    real = near_dedup.sketch
    monkeypatch.setattr(near_dedup, "sketch", lambda docs: real(docs).withColumn("bands", F.array(F.lit(7).cast("bigint"))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dedup.classes(df).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == brute(rows) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 7}


def test_one_of_each_class_stays(copies, clashing, none):
    expected = brute([(r["doc_id"], r["text"]) for r in copies.collect()])
    assert {r["doc_id"] for r in near_dedup.keep_one(copies).collect()} == set(expected.values())
    out = near_dedup.keep_one(clashing)
    assert shape(out, clashing)
    # The two rows of one doc_id are one document; its copy under another id goes.
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(
        ["1", "2", "3", "4", "5", "6", "7", "8", "10", "10", "None", "12", "13"])
    assert near_dedup.keep_one(none).count() == 0 and near_dedup.classes(none).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    powers, gaps = darts.Powers(), []
    for trial in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(400)] + ["again and again and again"] * 30
        texts = [" ".join(base), edited(rng, base, 3 * (trial % 12))]
        elements, doc = darts.shingles(pa.array(texts), powers)
        true = likeness(*map(shingles, texts))
        sets = [set(elements[doc == i].tolist()) for i in (0, 1)]
        assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == pytest.approx(true)
        values = darts.signatures(elements, doc, 2, 336)
        gaps.append((values[0] == values[1]).mean() - true)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.04


def test_every_size_of_text_fills_its_coordinates():
    powers = darts.Powers()
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 4, 5, 6, 50, 5000)] + [None]
    elements, doc = darts.shingles(pa.array(texts), powers)
    assert np.bincount(doc, minlength=8).tolist() == [0, 1, 1, 1, 2, 46, 4996, 0]
    values = darts.signatures(elements, doc, 8, 64)
    assert (values[[1, 2, 3, 4, 5, 6]] != ~np.uint64(0)).all() and (values[[0, 7]] == ~np.uint64(0)).all()
    alone = darts.signatures(*darts.shingles(pa.array(texts[5:6]), powers), 1, 64)
    assert (alone[0] == values[5]).all()  # the same whatever stands beside it


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
