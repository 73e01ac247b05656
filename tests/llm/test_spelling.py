"""Near words against every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import spelling
from cairn.llm.queries import QUERIES
from tests.conftest import DATA


def one_apart(a, b):
    """Whether two words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def brute(docs, min_count=5, times=5):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 6:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    form, out = {}, []
    near = {w: [v for k in (-1, 0, 1) for v in lengths.get(len(w) + k, ()) if one_apart(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_finds_all_words_with_one_error():
    """Every ordered pair, by the two halves; hits in one half only would miss some."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(700)} | {"x" * 5000, "x" * 5001})
    pairs = set()
    for way, turn in ((0, 1), (1, -1)):
        index = spelling.Index([w[::turn] for w in words])
        halves = np.array([-(-len(w) // 2) if way == 0 else len(w) // 2 for w in words])
        q, w = index.near([x[::turn] for x in words], halves)
        assert len(set(zip(q.tolist(), w.tolist()))) == len(q)
        pairs |= {(words[a], words[b]) for a, b in zip(q.tolist(), w.tolist())}
    assert pairs == {(a, b) for a in words for b in words if one_apart(a, b)}
    # Letters that the index lacks.
    assert spelling.Index(["abcdef"]).near(["abcdez", "zbcdef"], np.array([3, 3]))[0].tolist() == [1]


@pytest.mark.parametrize("shard_words", [20_000, 5])
def test_variants_by_brute_force(spark, shard_words):
    """Small shards cut shared halves into blocks; chains of forms lead to one root."""
    rng = random.Random(4)
    base = ["colour", "neighbour", "größere", "aaaaaa", "theatre"]
    texts = []
    for n, weight in enumerate((40, 8, 1)):
        for _ in range(weight * 12):
            words = []
            for w in base:
                for _ in range(n):
                    at = rng.randrange(2)
                    w = rng.choice([w[:at] + "q" + w[at:], w[:at] + w[at + 1:], w[:at] + "z" + w[at + 1:]])
                words.append(w.capitalize() if rng.random() < 0.2 else w)
            texts.append(" ".join(words) + "; short, ÀÿÀÿÀÿÀ.")
    docs = list(enumerate(texts)) + [(None, "colours " * 6), (7, None), (8, ""), (8, "Ünïcödé1Ünïcödé " * 3), (8, "Ünïcödé1Ünïcödé " * 3)]
    docs += [(9, "planetary " * 200 + "planetaryx " * 40 + "planetaryxy " * 8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = got(spelling.variants(df, shard_words=shard_words))
    assert found == brute(docs)
    assert any(form and root not in (form, word) for word, form, root, *_ in found)


def test_odd_documents(spark, odd, clashing, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(spelling.variants(clashing, min_count=2)) == brute(rows, min_count=2)
    assert spelling.variants(none).count() == 0


def test_query_on_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    query = QUERIES["op11_spelling_variants"](spark, DATA)
    assert got(query) == brute(docs)
    assert query.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
