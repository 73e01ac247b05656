import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import fingerprints as fp
from cairn.llm.queries import op9_bottom_k


def test_edited_texts_and_likeness(spark, docs):
    rows = {r["doc_id"]: r for r in op9_bottom_k(spark, "/root/testdata/sf0.001").collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    marks = {}
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[1][:n]
        assert rows[doc]["n_chars"] == len(text)
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert marks.setdefault(text, rows[doc]["fingerprint"]) == rows[doc]["fingerprint"]
        a, b = (set(zip(*[t.split()[k:] for k in range(5)])) for t in (text, edited))
        if len(a) > 50:
            assert abs(rows[doc]["near_edited"] - len(a & b) / len(a | b)) < 0.3
    assert len(rows) == len(texts)
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 0.5 > 0.1 > mean("near_next")


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    pairs = [(0, " ".join(words[:3000])), (1, " ".join(words[1000:]))]
    df = fp.with_sketch(spark.createDataFrame(pairs, "id bigint, text string"), "text", "s", k=512)
    a, b = (df.filter(F.col("id") == i).select(F.col("s").alias(n)) for i, n in ((0, "a"), (1, "b")))
    r = a.crossJoin(b).select(
        fp.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fp.containment(F.col("a"), F.col("b"), 512).alias("c"),
        fp.distinct_count(F.col("a"), 512).alias("n"), fp.merge(F.col("a"), F.col("b"), 512).alias("m")).first()
    assert r["j"] == pytest.approx(2000 / 4000, abs=0.1) and r["c"] == pytest.approx(2 / 3, abs=0.1)
    assert r["n"] == pytest.approx(2996, rel=0.15)
    whole = fp.merge_parts(df.withColumn("g", F.lit(1)), ["g"], "s", k=512).first()["s"]
    assert whole == r["m"] and whole == sorted(set(whole))


def test_odd_documents(odd, clashing, none):
    rows = fp.edited_pairs(clashing).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "" and by[1]["n_chars"] == 0 and by[1]["near_edited"] == 1.0
    # The null id is the smallest, so the largest is followed by it.
    text = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    n = len(text[13]) // 4
    assert by[13]["edited_sha256"] == hashlib.sha256((text[13][:-n] + text[None][:n]).encode()).hexdigest()
    assert by[None]["edited_sha256"] == hashlib.sha256(text[None][: len(text[None]) - len(text[None]) // 4].encode()).hexdigest()
    assert by[10]["fingerprint"] == by[11]["fingerprint"]
    assert fp.edited_pairs(none).count() == 0
