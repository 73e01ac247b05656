import re
import hashlib
from collections import defaultdict
from fractions import Fraction

from cairn.llm import mixing
from tests.llm.conftest import shape


def pour(total, children):
    """Budgets of children (capacity, weight) by filling the one that its share fills first, again and again."""
    given, open_, left = {}, {k: v for k, v in children.items() if v[1] > 0}, total
    while open_:
        weights = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c <= Fraction(left * w, weights)]
        if not full:
            break
        for k in full:
            given[k] = open_.pop(k)[0]
        left = total - sum(given.values())
    weights = sum(w for _, w in open_.values())
    for k, (_, w) in open_.items():
        given[k] = left * w // weights
    return given, set(open_), total - sum(given.values())


def test_budgets_of_a_family(spark):
    cases = {
        "plain": (100, {"a": (1000, 1), "b": (1000, 3)}),
        "short": (100, {"a": (10, 2), "b": (1000, 1), "c": (1000, 1)}),
        "chain": (100, {"a": (10, 5), "b": (30, 4), "c": (40, 3), "d": (500, 1)}),
        "exact": (100, {"a": (60, 1), "b": (40, 1)}),
        "zero": (50, {"a": (100, 0), "b": (20, 1), "c": (100, 1)}),
        "odd": (100, {"a": (1000, 1), "b": (1000, 1), "c": (1000, 1)}),
    }
    rows = [(p, k, c, w, total) for p, (total, kids) in cases.items() for k, (c, w) in kids.items()]
    df = spark.createDataFrame(rows, "p string, k string, capacity bigint, weight bigint, given bigint")
    found = defaultdict(dict)
    for r in mixing.deal(df, ["p"], ["k"]).collect():
        found[r["p"]][r["k"]] = r["budget"]
    for p, (total, kids) in cases.items():
        given, open_, over = pour(total, kids)
        assert sum(found[p].values()) == min(total, sum(c for c, w in kids.values() if w))
        for k, budget in found[p].items():
            assert budget - given[k] in ((0, 1) if k in open_ and over else (0,))


def test_shortage_stays_with_siblings_before_it_leaves(spark):
    leaves = spark.createDataFrame(
        [("x", "en", "a", 1, 10), ("x", "en", "b", 1, 500), ("x", "de", "c", 1, 500), ("y", "en", "d", 1, 500)],
        "domain string, lang string, source string, docs bigint, tokens bigint")
    out = {r["source"]: r["budget"] for r in mixing.budgets(leaves, mixing.LEVELS, {}, 400, 1).collect()}
    assert out == {"a": 10, "b": 90, "c": 100, "d": 200}
    out = {r["source"]: r["budget"] for r in mixing.budgets(leaves, mixing.LEVELS, {}, 1400, 1).collect()}
    assert out == {"a": 10, "b": 500, "c": 390, "d": 500} or sum(out.values()) == 1400


def place(epoch, doc):
    return hashlib.md5(f"{mixing.SEED}:{epoch}:{'null' if doc is None else doc}".encode()).hexdigest()


def check(df, share, epochs, small=False):
    rows = [r.asDict() for r in df.select("doc_id", "text", mixing.domain_of().alias("domain"), "lang", "source").collect()]
    for r in rows:
        r["tokens"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    stored = df.select("doc_id", mixing.domain_of().alias("domain"), "lang", "source", mixing.words().alias("tokens"))
    ends = mixing.shares(stored, mixing.LEVELS, mixing.WEIGHTS, share=share, epochs=epochs, bucket_rows=2 if small else 10_000)
    got = defaultdict(int)
    for r in mixing.taken(stored, ends, mixing.LEVELS).collect():
        got[r["doc_id"], r["epoch"]] += r["tokens_taken"]
    leaves = defaultdict(list)
    for r in rows:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    total = 0
    for r in ends.collect():
        own = leaves[r["domain"], r["lang"], r["source"]]
        assert r["tokens"] == sum(x["tokens"] for x in own) and r["budget"] <= epochs * r["tokens"]
        total += r["budget"]
        left, epoch, want = r["budget"], 0, {}
        while left > 0:
            for x in sorted(own, key=lambda x: place(epoch, x["doc_id"])):
                if left > 0 and x["tokens"]:
                    want[x["doc_id"], epoch] = want.get((x["doc_id"], epoch), 0) + min(left, x["tokens"])
                    left -= min(left, x["tokens"])
            epoch += 1
        ids = {x["doc_id"] for x in own}
        assert want == {k: v for k, v in got.items() if k[0] in ids and v}
    return total, sum(r["tokens"] for r in rows)


def test_streams_end_at_their_share(docs):
    total, there = check(docs, 1.0, 2)
    assert total == there
    total, there = check(docs, 0.4, 1, small=True)
    assert total == int(there * 0.4)


def test_odd_documents(odd, clashing, none):
    mixed = mixing.mixed(odd).collect()
    assert {r["doc_id"] for r in mixed if r["tokens_taken"]} <= {r["doc_id"] for r in odd.collect()}
    out = mixing.keep_mixed(clashing, share=0.9)
    assert shape(out, clashing) and 0 < out.count() <= clashing.count()
    assert mixing.mixed(none).count() == 0 and mixing.keep_mixed(none).count() == 0


def test_all_stays_where_all_is_asked_for(docs):
    assert mixing.keep_mixed(docs, share=1.0).count() == docs.count()


def least(leaves, weights, epochs):
    """Need and capacity of the root of a tree of leaves {path: tokens}, from the leaves up."""
    nodes = {path: (t, t * epochs) for path, t in leaves.items()}
    for depth in (2, 1, 0):
        families = defaultdict(list)
        for path, (need, capacity) in nodes.items():
            weight = weights.get(mixing.LEVELS[depth], {}).get(path[-1], 1)
            if weight:
                families[path[:-1]].append((need, capacity, weight))
        nodes = {}
        for path, kids in families.items():
            most = max(Fraction(need, weight) for need, _, weight in kids)
            nodes[path] = (sum(min(-(-most * w // 1), c) for _, c, w in kids), sum(c for _, c, _ in kids))
    return int(nodes[()][0])


def test_least_total_loses_no_leaf_and_keeps_weights(spark):
    leaves = {("x", "en", "a"): 100, ("x", "en", "b"): 50, ("x", "de", "c"): 90, ("y", "en", "d"): 64, ("z", "en", "e"): 7}
    weights = {"domain": {"x": 4, "y": 1, "z": 0}, "lang": {"en": 2}, "source": {"a": 1, "b": 3}}
    df = spark.createDataFrame([(*p, 1, t) for p, t in leaves.items()], "domain string, lang string, source string, docs bigint, tokens bigint")
    for epochs in (1, 2, 4, 9):
        total = mixing.least_total(df, mixing.LEVELS, weights, epochs)
        assert total == least(leaves, weights, epochs)
        out = {r["source"]: r["budget"] for r in mixing.budgets(df, mixing.LEVELS, weights, total, epochs).collect()}
        for (_, _, source), tokens in leaves.items():
            assert out[source] == 0 if source == "e" else tokens - 1 <= out[source] <= epochs * tokens
    assert out == {"a": 100, "b": 300, "c": 200, "d": 150, "e": 0}
    assert mixing.least_total(df.limit(0), mixing.LEVELS, weights, 2) == 0


def test_repeats_lose_no_document_and_hold_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in docs.select("doc_id", "text", mixing.domain_of().alias("domain"), "lang", "source").collect()]
    leaves = defaultdict(list)
    for r in rows:
        r["tokens"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    sizes = {path: sum(r["tokens"] for r in own) for path, own in leaves.items()}
    total = least(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    given = {(): total}
    for depth in range(3):
        for above in [p for p in given if len(p) == depth]:
            kids = {p[:depth + 1] for p in leaves if p[:depth] == above}
            room = {k: mixing.EPOCHS * sum(t for p, t in sizes.items() if p[:depth + 1] == k) for k in kids}
            family = {k: (room[k], mixing.WEIGHTS[mixing.LEVELS[depth]].get(k[-1], 1)) for k in kids}
            given.update(pour(given[above], family)[0])
    times = {r["doc_id"]: r["times"] for r in mixing.repeats(docs).select("doc_id", "times").collect()}
    assert set(times) == {r["doc_id"] for r in rows} and 1 <= min(times.values()) and max(times.values()) <= mixing.EPOCHS
    taken = defaultdict(int)
    for path, own in leaves.items():
        got = sum(times[r["doc_id"]] * r["tokens"] for r in own)
        assert abs(got - given[path]) <= max(r["tokens"] for r in own) / 2 + 4
        taken[path[0]] += got
    asked = mixing.WEIGHTS["domain"]
    for domain, weight in asked.items():
        assert abs(taken[domain] / sum(taken.values()) - weight / sum(asked.values())) < 0.01


def test_documents_without_weight_go_and_those_without_words_stay(odd, clashing, none):
    out = mixing.repeats(clashing)
    assert out.columns == ["doc_id", "text", "times"] and out.count() == clashing.count()
    weights = {"source": {"src0": 0}}
    left = [r for r in odd.collect() if r["source"] != "src0"]
    assert mixing.repeats(odd, weights).count() == mixing.with_weight(odd, weights).count() == len(left)
    assert shape(mixing.with_weight(clashing), clashing) and mixing.repeats(none).count() == 0
