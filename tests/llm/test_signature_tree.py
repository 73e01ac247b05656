"""Links and components against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import signature_tree
from cairn.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Components by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((d, len(s), low[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(rng, n, start, share=0.03):
    """Texts with a common part in all, families of edited copies, chains of links and short texts."""
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for f in range(n):
        base = [f"w{f}x{i}" for i in range(rng.choice([30, 80, 200]))]
        if f % 3 == 0:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.choice([1, 2, 6, 25])):
            text = [rng.choice("abc") + w if rng.random() < share * rng.random() else w for w in base]
            rows.append((start + len(rows), " ".join(text).title() if rng.random() < 0.3 else "  ".join(text)))
    drift = [f"c{i}" for i in range(100)]
    for step in range(12):  # each text is like the one before it, the last not like the first
        drift = drift[2:] + [f"d{step}", f"e{step}"]
        rows.append((start + len(rows), " ".join(drift)))
    rows += [(start + len(rows) + i, t) for i, t in enumerate(["one two", "One TWO", "two one", "a b c d", "a b c d e", "", None, " \n"])]
    return rows


@pytest.fixture(scope="module")
def copies():
    return near_copies(random.Random(8), 14, 100)


def test_components_by_brute_force(spark, copies):
    """With small trees and few common shingles, so that every level of the traversal is at work."""
    df = spark.createDataFrame(copies, SCHEMA).repartition(4)
    assert got(signature_tree.linked_documents(df)) == brute(copies)
    assert got(signature_tree.linked_documents(df, common=10**9, parts=2, fan=3)) == brute(copies)


def test_traversal_alone_finds_every_link(spark, copies):
    """All groups in one tree, nothing met before: pairs left hold every linked pair of different sets."""
    unique = {shingles(t): (i, t) for i, (_, t) in enumerate(copies) if shingles(t)}
    rows = sorted(unique.values())
    df = spark.createDataFrame(rows, SCHEMA)
    known = signature_tree.set_rows(df, np.zeros(0, np.uint64)).withColumn("rep", F.col("doc_id")).withColumnRenamed("doc_id", "doc")
    sets = signature_tree.full_sets(known, df)
    members = known.select(F.lit(1).cast("bigint").alias("key"), "rep", "n", F.col("rep").alias("root"))
    pairs = signature_tree.traversed(members, known, fan=3)
    left = {tuple(r) for r in pairs.collect()}
    every = [(a, b) for a, _ in rows for b, _ in rows if a > b]
    texts = dict(rows)
    links = set()
    for a, b in every:
        x, y = shingles(texts[a]), shingles(texts[b])
        if 100 * len(x & y) >= 80 * len(x | y):
            links.add((a, b))
    assert links and links <= left
    assert len(left) < len(every) / 2
    found = {tuple(r) for r in signature_tree.compared(pairs, sets).filter("linked").select("a", "b").collect()}
    assert found == links


def test_pairs_of_many_common_groups_are_looked_at_in_one(spark, monkeypatch):
    """A family in sixty groups, each without a few of its members: node pairs are few, no linked pair is lost."""
    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts = {}
    while len(texts) < 120:
        text = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2])):
            text[at] = f"e{len(texts)}x{at}"
        texts[len(texts)] = " ".join(text)
    df = spark.createDataFrame(sorted(texts.items()), SCHEMA)
    known = signature_tree.set_rows(df, np.zeros(0, np.uint64)).withColumn("rep", F.col("doc_id"))
    known = known.withColumnRenamed("doc_id", "doc").localCheckpoint()
    rows = [(key, rep) for key in range(60) for rep in texts if rng.random() > 0.05]
    keyed = spark.createDataFrame(rows, "key bigint, rep bigint").join(known.select("rep", "n"), "rep")
    members = keyed.select("key", "rep", "n", F.col("rep").alias("root")).localCheckpoint()
    looked, kept = [], signature_tree.durable

    def durable(table, label="step"):
        out = kept(table, label)
        if label == "node-pairs":
            looked.append(out.count())
        return out

    monkeypatch.setattr(signature_tree, "durable", durable)
    left = {tuple(r) for r in signature_tree.traversed(members, known, fan=4).collect()}
    many, looked[:] = sum(looked[:-1]), []
    signature_tree.traversed(members.filter("key = 0"), known, fan=4).collect()
    assert many < 12 * sum(looked[:-1])
    held = {}
    for key, rep in rows:
        held.setdefault(key, set()).add(rep)
    sets = {rep: shingles(t) for rep, t in texts.items()}
    links = {
        (a, b) for a in sets for b in sets
        if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and any({a, b} <= g for g in held.values())
    }
    assert links and links <= left


def test_members_meet_the_firsts_of_many_common_groups_once(spark):
    """A family in sixty groups, each without a few of its members: the join makes hardly a pair twice."""
    rng = random.Random(5)
    rows = [(key, rep, 100, rep) for key in range(60) for rep in range(300) if rng.random() > 0.05]
    members = spark.createDataFrame(rows, "key bigint, rep bigint, n bigint, root bigint").localCheckpoint()
    met = [tuple(r) for r in signature_tree._met(members, signature_tree.PARTS).collect()]
    held = {}
    for key, rep, _, _ in rows:
        held.setdefault(key, set()).add(rep)
    assert all(a > b and any({a, b} <= g for g in held.values()) for a, b in met)
    assert len({a for a, _ in met}) > 250
    assert len(met) < 1.5 * len(set(met)) and len(met) < len(rows)


def test_odd_documents(spark, odd, clashing, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(signature_tree.linked_documents(clashing)) == brute(rows)
    assert signature_tree.linked_documents(none).count() == 0


def test_query_on_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    query = QUERIES["op12_signature_join"](spark, DATA)
    assert got(query) == brute(docs)
    assert query.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
