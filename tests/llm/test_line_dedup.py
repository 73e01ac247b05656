import hashlib
from collections import Counter, defaultdict

import numpy as np

from cairn.llm import line_dedup
from tests.llm.conftest import shape

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    where = defaultdict(list)
    for doc, text in rows:
        for key in {x.strip(BLANK).translate(LOWER) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                where[key].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in where.items() if len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or last.get(x.strip(BLANK).translate(LOWER), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_report_and_texts_as_by_brute_force(odd, docs):
    for df in (odd, docs):
        expected = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        found = Counter(tuple(r) for r in line_dedup.line_report(df).collect())
        assert found == Counter((d, n, k, digest(t)) for d, n, k, t in expected)
        texts = Counter((r["doc_id"], r["text"] or "") for r in line_dedup.dedup_lines(df).collect())
        assert texts == Counter((d, t) for d, _, _, t in expected)


def test_columns_stay(odd, clashing, none):
    out = line_dedup.dedup_lines(clashing)
    assert shape(out, clashing) and out.count() == clashing.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] is None and rows[6]["n_chars"] == len(rows[6]["text"]) and rows[4]["n_chars"] == 3
    assert shape(line_dedup.dedup_lines(none), none) and line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.line_report(none).count() == 0


def test_perfect_hash_is_a_bijection_that_spark_evaluates(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 3000):
        h, f = (rng.integers(-(2**63), 2**63 - 1, n) for _ in range(2))
        h[: n // 4] = h[n // 4: 2 * (n // 4)]  # equal first halves must not matter
        pilots, slots = line_dedup.perfect_hash(h, f)
        assert sorted(slots) == list(range(n))
    common = spark.createDataFrame([(int(a), int(b), 3 + i, i) for i, (a, b) in enumerate(zip(h, f))], "h bigint, f bigint, n bigint, last bigint")
    index = line_dedup.build_shards(common, shard_keys=100)
    assert index.count() > 20
    asked = common.select("h", "f", (common.last + 0).alias("doc_id"))
    strange = spark.createDataFrame([(int(a), int(b) ^ 1, -1) for a, b in zip(h, f)], "h bigint, f bigint, doc_id bigint")
    found = line_dedup.probe(asked.unionByName(strange), index).collect()
    assert sorted((r["doc_id"], r["n"], r["last"]) for r in found) == [(i, 3 + i, i) for i in range(n)]
