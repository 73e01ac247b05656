"""Prefix trie of conversations, measured along its Euler tour.

1. A turn is two hashed words. A sequence of turns is known by running sums of
   words that depend on the turn and its place, so every prefix gets its name
   in one ordered scan, and a conversation of any length is cut into chunks.
2. Prefixes with one name are a node. A node is (smallest member, depth), its
   children stand in the order of their smallest members.
3. The Euler tour has an enter and an exit arc per node. Each arc knows the arc
   after it: from the first child, the next sibling or the parent.
4. List ranking: nodes in order of smallest member and depth are cut into
   chunks of bounded size. Nearly all arcs lead to an arc of the same chunk, as
   a conversation's own nodes and its near siblings lie together; a chunk
   follows them at once. What is left are the arcs where the tour enters a
   chunk. Their pointers double until each has met the end of the tour.
5. Ranks are places in the tour. Prefix sums of leaves and savings along it,
   in blocks of consecutive places, give each subtree as a difference: the sum
   at its exit less the sum before its enter.

No node's children, no conversation and no list of members has to fit into one
task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import ordered
from cairn.session import durable

#: Conversation c begins like c - c % FAMILY, for crc32(c) % HEADS turns.
FAMILY, HEADS = 20, 4
CHUNK_NODES = 50_000
BLOCK_PLACES = 65_536
#: Children of one parent, or turns of one conversation, that a plain window may see.
LARGE = 100_000
ID_BLOCK = 4096
END = -1
_SUMS = ("s0", "s1", "s2", "s3")
_LOW = 0xFFFFFFFF


def turns_in_order(talks: DataFrame, large: int = LARGE) -> DataFrame:
    """(conv_id, place, words, m0, m1): turns numbered from 1 by ``turn``, nulls first.

    A null role or text is an empty one. Turns at one place in the order go by
    their hash; repeated rows are turns of their own. Rows without conv_id
    belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = talks.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.xxhash64(role, text).alias("m0"), F.xxhash64(F.lit(1), text, role).alias("m1"),
    )
    order = [F.col("turn").asc_nulls_first(), "m0", "m1"]
    rows = ordered.scan(
        durable(rows, "turns"), ["conv_id"], order, limit=large, chunk_rows=large, place=ordered.total(F.lit(1)),
    )
    return durable(rows.drop("turn"), "placed-turns")


def rebuilt(placed: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, length, words, m0, m1), each rebuilt.

    Conversation c takes the first h turns of c - c % ``family``, or what there
    is of them, and then its own after its first h; h is crc32 of its decimal
    number modulo ``heads``.
    """
    counted = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counted.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
    )
    bases = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lent = F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))
    length = F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))
    convs = convs.join(bases, "base", "left").withColumn("lent", lent).withColumn("length", length)
    convs = durable(convs.select("conv_id", "h", "base", "lent", "length"), "conversations")
    columns = ("conv_id", "depth", "length", "words", "m0", "m1")
    first = placed.filter(F.col("place") < heads).withColumnRenamed("conv_id", "base")
    taken = convs.filter("lent > 0").join(first, "base").filter("place <= lent")
    own = placed.join(convs.filter("length > lent"), "conv_id").filter("place > h")
    both = taken.withColumn("depth", F.col("place")).select(*columns).unionByName(
        own.withColumn("depth", F.col("place") - F.col("h") + F.col("lent")).select(*columns)
    )
    return convs.select("conv_id", "length"), durable(both, "rebuilt")


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth)]


def prefixes(convs: DataFrame, turns: DataFrame, large: int = LARGE) -> DataFrame:
    """(k0, k1, p0, p1, conv_id, depth, words, ends): each rebuilt prefix, its name and that of the one before.

    ``ends`` marks the whole conversation. The root is the empty prefix of every one.
    """
    a = F.xxhash64("depth", "m0", "m1")
    b = F.xxhash64("m1", "depth", "m0")
    parts = [a.bitwiseAND(_LOW), F.shiftrightunsigned(a, 32), b.bitwiseAND(_LOW), F.shiftrightunsigned(b, 32)]
    rows = durable(turns.select("conv_id", "depth", "length", "words", *[p.alias(f"own_{s}") for p, s in zip(parts, _SUMS)]), "parts")
    rows = ordered.scan(
        rows, ["conv_id"], ["depth"], limit=large, chunk_rows=large, **{s: ordered.total(F.col(f"own_{s}")) for s in _SUMS}
    )
    depth = F.col("depth").cast("bigint")
    own = _name(depth, [F.col(s) for s in _SUMS])
    before = _name(depth - 1, [F.col(s) - F.col(f"own_{s}") for s in _SUMS])
    zero = F.lit(0).cast("bigint")
    top, none = _name(zero, [zero] * 4), F.lit(None).cast("bigint")
    named = rows.select(
        *[c.alias(n) for c, n in zip([*own, *before], ("k0", "k1", "p0", "p1"))],
        "conv_id", depth.alias("depth"), "words", (F.col("depth") == F.col("length")).alias("ends"),
    )
    roots = convs.select(
        *[c.alias(n) for c, n in zip([*top, none, none], ("k0", "k1", "p0", "p1"))],
        "conv_id", zero.alias("depth"), zero.alias("words"), (F.col("length") == 0).alias("ends"),
    )
    return durable(named.unionByName(roots), "prefixes")


def list_digest(rows: DataFrame, keys: list[str], number: str, name: str) -> DataFrame:
    """SHA-256 of the ascending decimal numbers of each key, joined by commas.

    Numbers are sorted by range over all tasks and joined in blocks there, so a
    key of very many numbers reaches its last task as few blocks, which are
    hashed one after the other.
    """
    kinds = {k: rows.schema[k].dataType.simpleString() for k in [*keys, number]}
    width = len(keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None
        for batch in batches:
            out = []
            for *own, value in zip(*[batch.column(i).to_pylist() for i in range(width + 1)]):
                if own != key or len(held) >= ID_BLOCK:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held = own, []
                held.append(value)
            yield from made(out)
        if held:
            yield from made([(*key, held[0], ",".join(map(str, held)))])

    def made(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "first", "ids"], row)) for row in out])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*[batch.column(i).to_pylist() for i in range(width + 2)]):
                if own != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*keys, name], row)) for row in out])
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, name], (*key, state.hexdigest())))])

    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    sort = [*keys, number]
    placed = rows.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort)
    joined = placed.mapInArrow(blocks, f"{head}, first {kinds[number]}, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, f"{head}, {name} string")


def tree_of(named: DataFrame, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """One row per node, in chunks: k0, k1, conv_id, depth, parent_conv_id, n_convs, words, node, part."""
    nodes = durable(named.groupBy("k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("words").alias("words"), F.min("p0").alias("p0"), F.min("p1").alias("p1"),
    ), "nodes")
    above = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    rows = durable(nodes.join(above, ["p0", "p1"], "left").drop("p0", "p1"), "nodes")
    return ordered.chunked(rows, [], ["conv_id", "depth"], chunk_nodes).withColumnsRenamed({"_pos": "node", "_chunk": "part"})


def tour(tree: DataFrame, large: int = LARGE) -> DataFrame:
    """The tree with n_children and the arcs after its own: ``into`` after enter, ``out`` after exit.

    Arcs of a node are 2 * node (enter) and 2 * node + 1 (exit); the exit of the
    root leads to ``END``.
    """
    families = tree.filter("depth > 0").groupBy("parent_conv_id", "depth").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n_children"),
    )
    parents = tree.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")
    )
    families = durable(families.join(parents, ["parent_conv_id", "depth"]), "families")
    rows = ordered.scan(
        tree, ["parent_conv_id", "depth"], [F.col("conv_id").desc()],
        limit=large, chunk_rows=large, sibling=ordered.previous(F.col("node")),
    )
    down = families.select(F.col("parent").alias("node"), "first", "n_children")
    up = families.select(F.col("last").alias("node"), F.col("parent").alias("up"))
    rows = rows.join(down, "node", "left").join(up, "node", "left")
    into = F.coalesce(2 * F.col("first"), 2 * F.col("node") + 1)
    out = F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1, F.lit(END).cast("bigint"))
    return durable(rows.select(
        *tree.columns, F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), into.alias("into"), out.alias("out")
    ), "tour")


def follow(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists within one chunk: for each arc where its run leaves the chunk, after how many steps, and whether it begins one.

    ``at`` are the chunk's arcs in ascending order, ``after`` the arcs after them.
    """
    n = len(at)
    spot = np.minimum(np.searchsorted(at, after), n - 1)
    inside = at[spot] == after
    to = np.where(inside, spot, np.arange(n))
    steps = inside.astype(np.int64)
    begins = np.ones(n, bool)
    begins[spot[inside]] = False
    while True:
        further = to[to]
        if (further == to).all():
            break
        steps = steps + steps[to]
        to = further
    return after[to], steps + 1, begins


def ranks(arcs: DataFrame) -> DataFrame:
    """Places (node, entered, left) of all nodes in the tour, from (part, node, into, out)."""

    def contract(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        pos = part["node"].to_numpy()
        at = np.stack([2 * pos, 2 * pos + 1], 1).ravel()
        after = np.stack([part["into"].to_numpy(), part["out"].to_numpy()], 1).ravel()
        to, steps, begins = follow(at, after)
        return pd.DataFrame({
            "node": pos, "into": to[::2], "out": to[1::2], "into_steps": steps[::2], "out_steps": steps[1::2],
            "into_first": begins[::2], "out_first": begins[1::2],
        })

    schema = "node bigint, into bigint, out bigint, into_steps bigint, out_steps bigint, into_first boolean, out_first boolean"
    short = durable(arcs.select("part", "node", "into", "out").groupBy("part").applyInPandas(contract, schema), "runs")
    # left: steps to the end of the tour once ``to`` is END; until then to the arc ``to``.
    runs = [
        short.filter(f"{way}_first").select(
            (2 * F.col("node") + odd).alias("arc"), F.col(way).alias("to"), F.col(f"{way}_steps").alias("left"))
        for odd, way in enumerate(("into", "out"))
    ]
    runs = durable(runs[0].unionByName(runs[1]), "runs")
    while not runs.filter(F.col("to") != END).isEmpty():
        further = runs.select(F.col("arc").alias("to"), F.col("to").alias("next"), F.col("left").alias("more"))
        moved = runs.filter(F.col("to") != END).join(further, "to").select(
            "arc", F.col("next").alias("to"), (F.col("left") + F.col("more")).alias("left"))
        runs = durable(runs.filter(F.col("to") == END).unionByName(moved), "runs")
    whole = 2 * arcs.count()
    ends = runs.select(F.col("arc").alias("_arc"), F.col("left").alias("_left"))
    for way, name in (("into", "entered"), ("out", "left")):
        short = short.join(ends, F.col(way) == F.col("_arc"), "left")
        left = F.col(f"{way}_steps") + F.coalesce("_left", F.lit(0).cast("bigint"))
        short = short.withColumn(name, F.lit(whole) - left).drop("_arc", "_left")
    return short.select("node", "entered", "left")


def subtree_sums(nodes: DataFrame, values: list[str], block: int = BLOCK_PLACES) -> DataFrame:
    """(node, values): sums over subtrees, from (node, entered, left, values) with gapless places of a tour."""
    arc = F.explode(F.array(
        F.struct(F.col("entered").alias("at"), F.lit(True).alias("enters")),
        F.struct(F.col("left").alias("at"), F.lit(False).alias("enters")),
    ))
    arcs = nodes.select("node", *values, arc.alias("a")).select(
        "node", "a.*", F.expr(f"a.at div {block}").alias("block"),
        *[F.when(F.col("a.enters"), F.col(v)).otherwise(0).alias(v) for v in values],
    )
    arcs = durable(arcs, "arcs")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = arcs.groupBy("block").agg(*[F.sum(v).alias(f"all_{v}") for v in values]).select(
        "block", *[F.coalesce(F.sum(f"all_{v}").over(before), F.lit(0)).alias(f"ahead_{v}") for v in values]
    )
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = arcs.withColumns({f"upto_{v}": F.sum(v).over(inside) for v in values}).join(carried, "block")
    upto = {v: F.col(f"upto_{v}") + F.col(f"ahead_{v}") for v in values}
    return summed.groupBy("node").agg(*[
        (F.max(F.when(~F.col("enters"), upto[v])) - F.max(F.when(F.col("enters"), upto[v] - F.col(v)))).alias(v)
        for v in values
    ])


def trie(
    talks: DataFrame, family: int = FAMILY, heads: int = HEADS,
    chunk_nodes: int = CHUNK_NODES, block: int = BLOCK_PLACES, large: int = LARGE,
) -> DataFrame:
    """One row per node of the prefix trie of conversations (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the
    members that end here). The last turn of node (conv_id, depth) is that of
    conversation conv_id at place depth. Other columns are not read. No
    conversations, no rows; see ``turns_in_order`` for nulls and ties.
    """
    convs, turns = rebuilt(turns_in_order(talks, large), family, heads)
    named = prefixes(convs, turns, large)
    tree = tree_of(named, chunk_nodes)
    nodes = tour(tree, large)
    leaf = (F.col("n_children") == 0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.col("words")
    places = nodes.select("node", leaf.alias("n_leaves"), saved.alias("saved_tokens")).join(ranks(nodes), "node")
    sums = subtree_sums(durable(places, "places"), ["n_leaves", "saved_tokens"], block)
    digests = list_digest(named.filter("ends"), ["k0", "k1"], "conv_id", "ends_sha256")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(sums, "node").join(digests, ["k0", "k1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
