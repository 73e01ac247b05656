import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality_classifier, quality_rules
from cairn.llm.queries import op6_rule_ensemble
from tests.llm.conftest import shape

HERE = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_as_by_brute_force(odd, clashing, docs):
    for df in (odd, clashing, docs):
        want = Counter((r["doc_id"], *counts(r["text"])) for r in df.collect())
        rows = quality_rules.judged(df).collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert got == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_sketch_quartiles_are_near_and_merge(spark):
    rng = np.random.default_rng(4)
    values = rng.lognormal(0, 1, 4000)
    rows = [("en", f"s{i % 7}", 0.0 if i % 50 == 0 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_ratio double")
    df = df.select("*", *[F.lit(1.0).alias(c) for c in quality_rules.RATIOS if c != "symbol_ratio"])
    parts = quality_rules.sketches(df)
    got = quality_rules.quartiles(parts, ["lang"]).filter("rule = 'symbol_ratio'").first()
    ordered = sorted(r[2] for r in rows)
    for name, q in (("q1", 0.25), ("q3", 0.75)):
        assert got[name] == pytest.approx(ordered[math.ceil(q * len(ordered)) - 1], rel=0.0101)
    assert got["docs"] == 4000


def test_small_groups_take_wider_sketches(spark):
    rows = [("en", "big", 1.0)] * 300 + [("en", "small", 50.0)] * 3 + [(None, None, 9.0)]
    df = spark.createDataFrame(rows, "lang string, source string, word_length double")
    df = df.select("*", *[F.lit(0.0).alias(c) for c in quality_rules.RATIOS if c != "word_length"])
    found = {r["source"]: r for r in quality_rules.fences(quality_rules.sketches(df)).collect()}
    assert found["small"]["most_word_length"] == found["big"]["most_word_length"] == found[None]["most_word_length"] < 50


def test_fences_come_from_the_sketch_alone(spark):
    rows = [("en", "a", 0.0, 0.0, 0.0, 5.0)] * 997 + [("en", "a", 0.08, 0.0, 0.0, 5.0), ("en", "a", 0.0, 0.25, 0.0, 7.0),
                                                     ("en", "a", 0.0, 0.0, 0.29, 5.0)]
    rows += [("en", "b", 0.01 + i % 10 / 1000, 0.0, 0.0, 5.0 + i % 10 / 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "lang string, source string, symbol_ratio double, dup_line_ratio double, "
                                     "repeat_ratio double, word_length double")
    parts = quality_rules.sketches(df)
    found = {r["source"]: r for r in quality_rules.fences(parts).collect()}
    a, b = found["a"], found["b"]
    assert (a["most_symbol_ratio"], a["most_dup_line_ratio"], a["most_repeat_ratio"]) == (0, 0, 0)
    assert a["least_word_length"] <= 5.0 <= a["most_word_length"] < 5.2  # a group of one length keeps it
    assert 0.019 < b["most_symbol_ratio"] < 0.04 and 5.9 < b["most_word_length"] < 8.0
    held = quality_rules.fences(parts, floors=quality_rules.RATIOS).collect()
    assert all(r[f"most_{rule}"] >= floor for r in held for rule, floor in quality_rules.RATIOS.items())


def test_far_outside_its_group_goes(spark):
    words = lambda i: [f"w{(i * 37 + k * 11) % 5000:04d}" for k in range(100)]
    texts = [" ".join(words(i)) for i in range(300)] + [" ".join(words(7)[:92] + ["#" + w for w in words(7)[92:]])]
    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    assert {r["doc_id"] for r in quality_rules.keep_good(df).collect()} == set(range(300))
    held = quality_rules.judged(df, floors=quality_rules.RATIOS).filter("doc_id = 300").first()
    assert held["n_symbols"] == 8


def test_rules_filter(odd, clashing, docs, none):
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs).collect()}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {d for d, k in verdict.items() if k}
    out = quality_rules.keep_good(clashing)
    assert shape(out, clashing) and {r["doc_id"] for r in out.collect()} == {5, 8, 9}
    assert quality_rules.judged(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 1.5)
   If (feature 1 <= 2.0E-4)
    Predict: 0.0
   Else (feature 1 > 2.0E-4)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 0.0
"""
    low, high = ("a", True, 1.5), ("a", False, 1.5)
    assert quality_classifier.paths(tree, ["a", "b"]) == [
        (low,), (low, ("b", True, 2e-4)), (low, ("b", False, 2e-4)), (high,)]
    rule = (("a", True, 3.0), ("a", True, 1.0), ("a", False, 0.0))
    assert quality_classifier.tighten(rule) == (("a", False, 0.0), ("a", True, 1.0))


def test_compiled_score_is_the_sum_of_fired_rules(spark):
    df = spark.createDataFrame([(i / 10, float(i % 3)) for i in range(40)], "a double, b double")
    model = quality_classifier.Ensemble([((("a", False, 1.0), ("b", True, 1.0)), 2.0), ((("b", False, 1.5),), -1.0)], 0.5)
    for r in df.select("a", "b", model.score().alias("s")).collect():
        total = 0.5 + 2.0 * (r["a"] > 1.0 and r["b"] <= 1.0) - (r["b"] > 1.5)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{HERE}/labels.parquet")
    rows = op6_rule_ensemble(spark, HERE).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_odd_documents(spark, odd, clashing, none):
    labels = spark.createDataFrame([(4, 0), (8, 1), (9, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = quality_classifier.scored(clashing, labels, "quality").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality_classifier.scored(odd, labels.limit(0), "quality").count() == odd.count()
    assert quality_classifier.scored(none, labels, "quality").count() == 0
    out = quality_classifier.keep_good(clashing, quality_classifier.Ensemble([], 0.0), 0.4)
    assert shape(out, clashing) and out.count() == clashing.count()
