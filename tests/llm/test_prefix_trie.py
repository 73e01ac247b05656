"""Tries against plain dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import prefix_trie
from cairn.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn int, role string, text string"


def brute(rows, family=20, heads=4):
    """All nodes by walking every prefix of every rebuilt conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole = own.get(c - c % family, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.append((
            min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members),
            sum(1 for p in nodes if p and p[:-1] == path), sum(1 for p in below if p not in inner), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def made(seed, convs, alphabet=3, longest=7):
    """Conversations that share beginnings, some ids missing, roles and texts null or empty."""
    rng = random.Random(seed)
    words = [None, "", "a", "b c", "d  e\tf\n", "g"][: alphabet + 2]
    rows = []
    for c in range(convs):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk_nodes": 7, "block": 5, "large": 6}])
def test_trie_by_brute_force(spark, sizes):
    rows = made(5, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.trie(df, **sizes)) == brute(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    """A conversation of 300 turns, 120 equal ones, a chain of single children."""
    rows = [(1000, t, "user", f"turn {t % 3}") for t in range(300)]
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(120) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.trie(df, chunk_nodes=50, block=64, large=40)) == brute(rows)


def test_odd_tables(spark):
    """Null turns come first; repeated rows are turns; rows without conversation go; extra columns stay unread."""
    rows = [
        (None, 0, "user", "x"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, None, None), (1, 2, "user", "two three"),
        (20, 0, "user", ""), (21, 0, "bot", "y " * 50_000), (40, 5, "user", "z"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit(9).alias(c) for c in ("_pos", "depth", "place", "k0", "words", "_chunk", "length")])
    assert got(prefix_trie.trie(clashing)) == brute(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    # Conversations whose every turn is replaced by none are members of the root alone.
    lone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:1]
    rows = [(lone[0], 0, "user", "gone")]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_runs_of_a_shuffled_list():
    rng = np.random.default_rng(3)
    arcs = rng.permutation(1000)
    after = np.empty(1000, np.int64)
    after[arcs[:-1]], after[arcs[-1]] = arcs[1:], -1
    own = np.sort(rng.choice(1000, 400, replace=False))
    to, steps, begins = prefix_trie.follow(own, after[own])
    inside = set(own.tolist())
    for arc, end, n, first in zip(own.tolist(), to.tolist(), steps.tolist(), begins.tolist()):
        at = arc
        for _ in range(n):
            at = int(after[at])
        assert at == end and (end == -1 or end not in inside)
        assert first == (arc == arcs[0] or int(arcs[np.flatnonzero(arcs == arc)[0] - 1]) not in inside)


def test_query_on_given_conversations(spark):
    from tests.conftest import DATA

    talks = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    query = QUERIES["op13_prefix_trie"](spark, DATA)
    assert got(query) == brute(rows)
    assert [t for _, t in query.dtypes] == ["bigint"] * 7 + ["string"]
