import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import language
from cairn.llm.queries import op1_language_filters

HERE = "/root/testdata/sf0.001"


def test_grams_stay_inside_their_text():
    hashes, doc = language.grams(pa.array(["abc abc", None, "", "ab", "ABC"]))
    own = [sorted(hashes[doc == i].tolist()) for i in range(5)]
    assert own[1] == own[2] == own[3] == [] and set(own[4]) < set(own[0])
    assert len(own[0]) == 5 + 3


def test_filter_never_misses_and_is_corrected():
    rng = np.random.default_rng(0)
    kept = {name: rng.integers(0, 2**63, 5000).astype(np.uint64) for name in ("aa", "bb", "cc")}
    model = language.build(kept, {"aa": 1, "bb": 5, "cc": 2}, rows=1 << 14)
    for at, name in enumerate(model.languages):
        assert (model.masks(kept[name]) >> at & 1).all()
        strange = model.masks(rng.integers(0, 2**63, 20_000).astype(np.uint64)) >> at & 1
        assert abs(strange.mean() - model.wrong[at]) < 0.02
    assert model.languages[model.fallback] == "bb"


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(3)
    letters = {f"l{k:03d}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(150)}
    rows = [(150 * i + k, "".join(rng.choice(own, 200)), name)
            for k, (name, own) in enumerate(letters.items()) for i in range(1 + (k < 100))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    assert model.languages == sorted(letters) and model.table.shape == (language.ROWS, 3)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert found == {d: name for d, _, name in rows}


def test_held_out_texts(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_filters(spark, HERE).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.93


def test_odd_documents(spark, odd, clashing, none):
    model = language.fit(odd.select("doc_id", "text", "lang"))
    rows = language.identify(clashing, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    answers = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert answers[1] == answers[2] == answers[3] == "und" and "und" not in [answers[k] for k in (4, 8, 12, 13, None)]
    assert language.identify(none, model).count() == 0
    nothing = language.fit(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
