from collections import Counter

import corpus_pipeline
from cairn.llm import mixing, toxicity
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_classes

HERE = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        out = stage(spark, now, HERE)
        now = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, now)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{HERE}/labels.parquet").collect()}
    before, after = (dict((r["doc_id"], r["text"]) for r in df.collect()) for df in seen["toxicity"])
    assert all(after[d] == before[d] for d in after)
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in clean) >= 0.95 * len(clean)

    before, after = seen["line_dedup"]
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in before.collect()]) if t.strip()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want

    before, after = seen["near_dedup"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == set(classes.values())

    before, after = seen["mixing"]
    assert 0.85 * before.count() < after.count() <= before.count()
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}

    before, after = seen["packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    for name in names[:-1]:
        assert seen[name][1].columns == docs.columns


def test_odd_documents_pass_all_stages(spark, odd, clashing, none):
    for df in (odd, clashing, none):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, HERE)
            now = spark.createDataFrame(out.collect(), out.schema)
        assert now.count() >= (0 if df is none else 8)


def test_toxic_documents_go(spark):
    """The stage rejects exactly what the operator's verdict calls toxic, and labelled toxic documents are among it.

    How many of them is a matter of the labels there are; the README has the figures.
    """
    folder = HERE.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxic_out(spark, docs, folder).select("doc_id").collect()}
    model = toxicity.fit(toxicity.labelled(docs, labels, "toxic"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).select("doc_id", "score").collect()}
    assert kept == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC}
    toxic, clean = ([r["doc_id"] for r in labels.collect() if r["toxic"] == k] for k in (1, 0))
    gone = lambda ids, least: sum(scores[d] >= least for d in ids) / len(ids)
    print("gone", {least: (round(gone(toxic, least), 3), round(gone(clean, least), 3)) for least in (0.3, 0.5)})
    assert gone(toxic, corpus_pipeline.TOXIC) > gone(clean, corpus_pipeline.TOXIC)


def test_sequences_hold_the_weights_and_every_document(spark, docs):
    """The mix repeats documents instead of leaving some out: pieces of each epoch are those of the first."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[-2:]:
        out = stage(spark, now, HERE)
        now = spark.createDataFrame(out.collect(), out.schema)
    times = {r["doc_id"]: r["times"] for r in mixing.repeats(docs).collect()}
    assert set(times) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    pieces, ends = {}, Counter()
    for r in now.collect():
        pieces.setdefault((r["doc_id"], r["epoch"]), set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        assert r["offset"] + r["length"] <= 1024
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024
    assert Counter(doc for doc, _ in pieces) == times and max(times.values()) > 1
    assert all(pieces[doc, epoch] == pieces[doc, 0] for doc, epoch in pieces)
