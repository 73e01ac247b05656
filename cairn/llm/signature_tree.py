"""Documents linked by the Jaccard similarity of their word shingles, by signature trees.

1. Every text becomes a set of hashed shingles. Equal sets are one
   representative from here on.
2. Of n shingles in one order for all, similar sets share one of the first few
   (n less the overlap they need, plus one). Shingles that a sample of the texts
   shows to be common come last in that order, so what many documents share
   rarely is among the first. A few more of them tell, by how many are found
   elsewhere, who cannot have a partner at all. Representatives with a common
   first shingle are a group; groups of the same members are one.
3. A group's members, ordered by size and component, are the lowest nodes of a
   tree. Each node holds the bitmap of its members' shingles, OR-combined, the
   range of their sizes and of their components. A dual traversal goes down
   pairs of nodes, all groups at once, and leaves out pairs whose sizes differ
   too much, whose bitmaps have too few bits in common for the overlap that
   their sizes need, or that are of one component already.
4. Pairs of members that are left are compared exactly; only now are whole sets
   made again from the texts, of members of such pairs. Before the traversal
   members meet the first of their group, then the firsts of up to sixteen parts
   of it (of sixteen members or more each; in their first common group only), so that a group of thousands of copies is one component before any pair
   of nodes is looked at.
5. Two members of several groups are looked at in the first of them only. Groups
   have an order, the largest first, and a member of a group knows some groups
   before it that it is in, too. Members with such a group in common have been
   left to it, and so are nodes if one group holds all members of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import darts
from cairn.llm.common import likely, short_batches, small_batches
from cairn.llm.near_dedup import components
from cairn.operators import ordered
from cairn.session import discard, durable

WIDTH = 5
#: Sets are linked from 80 of 100 on.
SHARE = 80
BATCH_BYTES = 1 << 19
#: Longs in a bitmap, children of a node, and parts of a group whose firsts are met.
BITMAP, FAN, PARTS = 32, 16, 16
#: So many earlier groups of it does a member of a group know; with fewer, pairs are looked at more often.
EARLIER = 8
#: A tenth of all shingles beside the first ones tells who may have a partner.
MORE = 10
#: The order of shingles follows a sample of so many texts; a shingle in so many of them is common.
SAMPLE_ROWS, COMMON, MOST_COMMON = 10_000, 4, 1 << 18
U = np.uint64


def shingle_sets(texts: pa.Array, powers: darts.Powers, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text and the text of each, by text and hash.

    Words are runs of other than ASCII blanks with A-Z in lower case. A text of
    fewer words than ``width`` has one shingle, all its words; a text without
    words or null has none.
    """
    words, doc = darts.word_hashes(pc.ascii_lower(texts.fill_null("")), powers)
    n = len(words)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(texts))
    place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    made = np.zeros(n, U)
    for k in range(width):
        ahead = np.zeros(n, U)
        ahead[:n - k] = words[k:]
        made = darts.mix(made * U(darts.POWER) + np.where(place + k < count[doc], ahead, darts.STEP) + U(k))
    good = (place + width <= count[doc]) | ((place == 0) & (count[doc] < width))
    made, doc = made[good], doc[good]
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    return made[fresh], doc[fresh]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of consecutive runs of values that stop at ``ends``."""
    upto = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])[ends]
    return np.diff(upto, prepend=U(0))


def first_shingles(n: np.ndarray, share: int) -> np.ndarray:
    """How many of the first of n shingles two sets must share one of, to be linked."""
    return n - -(-n * share // 100) + 1


def more_shingles(n: np.ndarray) -> np.ndarray:
    """How many further shingles are looked at: linked sets share that many of their first ones beside the one."""
    return n // MORE


def set_rows(docs: DataFrame, common: np.ndarray, share: int = SHARE, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n (distinct shingles), s0 and s1 (hash of the set), first (its first shingles and some more), low, bits.

    ``common`` are shingles that come last, in the given order. ``bits`` is the
    bitmap of the set, ``low`` the number of its bits less n.
    """
    kind = docs.schema["doc_id"].dataType
    by_value = np.argsort(common)
    known = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                made, doc = shingle_sets(batch.column("text"), powers, width)
                n = np.bincount(doc, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows, np.int64)
                ends = np.cumsum(n)
                s0, s1 = _sums(darts.mix(made), ends), _sums(darts.mix(made ^ darts.MIX1), ends)
                table = np.zeros((batch.num_rows, 64 * BITMAP), bool)
                table[doc, (darts.mix(made + darts.STEP) % U(64 * BITMAP)).astype(np.int64)] = True
                low = table.sum(axis=1) - n
                bits = np.packbits(table, axis=1, bitorder="little").view(np.int64)
                if len(known) and len(made):
                    at = np.minimum(np.searchsorted(known, made), len(known) - 1)
                    late = np.where(known[at] == made, by_value[at] + 1, 0)
                    made = made[np.lexsort((made, late, doc))]
                place = np.arange(len(made)) - np.repeat(ends - n, n)
                size = np.where(n > 0, first_shingles(n, share) + more_shingles(n), 0)
                first = made[place < size[doc]] if len(made) else made
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(first.view(np.int64))), pa.array(low.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BITMAP), pa.array(bits.ravel()))],
                    ["doc_id", "n", "s0", "s1", "first", "low", "bits"],
                )

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("n", "s0", "s1")],
                           T.StructField("first", longs), T.StructField("low", T.LongType()), T.StructField("bits", longs)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def common_shingles(docs: DataFrame, rows: int = SAMPLE_ROWS, least: int = COMMON, width: int = WIDTH) -> np.ndarray:
    """Shingles of at least ``least`` of ``rows`` sampled texts, those of lowest hashed doc_id; the most common last.

    They settle an order only: no link depends on which shingles are found here.
    At most 2**18 of them come to the driver and go to the tasks.
    """
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = durable(ids.withColumnRenamed("doc_id", "_id"), "sampled-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                made, _ = shingle_sets(batch.column("text"), powers, width)
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], ["key"])

    counted = texts.mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = counted.orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).toPandas()
    return kept["key"].to_numpy(np.int64)[::-1].copy().view(U)


def shared(keys: DataFrame) -> DataFrame:
    """Rows (key, rep, at) of keys that two rows or more have, sorted once; no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again_before = None, False  # the newest row is not passed on before the next is known
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            key = whole.column("key").to_numpy(zero_copy_only=False)
            same = np.concatenate([[again_before], key[1:] == key[:-1]])
            yield whole.slice(0, len(key) - 1).filter(pa.array((same[:-1] | same[1:])))
            last, again_before = whole.slice(len(key) - 1), bool(same[-1])
        if last is not None and again_before:
            yield last

    placed = keys.select("key", "rep", "at").repartition("key").sortWithinPartitions("key", "rep")
    return placed.mapInArrow(run, "key bigint, rep bigint, at int")


def groups_of(rows: DataFrame, reps: DataFrame, share: int = SHARE) -> DataFrame:
    """(key, rep, n): groups of members that may have a partner, from ``shared`` rows of ``reps`` (rep, n).

    Of two linked sets, the first common shingle is one of the first of either,
    and as many as both look at besides are common, too. The smallest partner
    looks at the fewest.
    """
    n = F.col("n")
    least = F.expr(f"int(ceil(n * {share} / 100.0 - 1e-9)) div {MORE}") + 1
    held = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("held")).join(reps.select("rep", "n"), "rep")
    chief = n - F.ceil(n * share / 100 - 1e-9) + 1
    held = held.filter(F.col("held") >= least).select("rep", "n", chief.alias("chief"))
    rows = durable(rows.join(held, "rep").filter("at < chief").select("key", "rep", "n"), "partners")
    x0, x1 = F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64(F.lit(7), "rep"))
    known = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), x0.alias("x0"), x1.alias("x1")).filter("size > 1")
    once = known.groupBy("size", "x0", "x1").agg(F.min("key").alias("key"))
    return durable(rows.join(once.select("key"), "key", "left_semi"), "groups")


def full_sets(wanted: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rep, set) of wanted (rep, doc, s0, s1), a stored table: all their shingles.

    Texts that are not wanted are held back by a filter of fixed size before
    they are shuffled. Of rows under one doc_id that with the wanted set counts.
    """
    asked = wanted.select("rep", F.col("doc").alias("doc_id"), "s0", "s1")
    texts = likely(docs.select("doc_id", "text").filter("doc_id is not null"), "doc_id", wanted.select("doc"))
    rows = texts.join(asked, "doc_id").select("rep", "s0", "s1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                made, doc = shingle_sets(batch.column("text"), powers, width)
                ends = np.cumsum(np.bincount(doc, minlength=batch.num_rows)) if len(doc) else np.zeros(batch.num_rows, np.int64)
                right = _sums(darts.mix(made), ends).view(np.int64) == batch.column("s0").to_numpy()
                right &= _sums(darts.mix(made ^ darts.MIX1), ends).view(np.int64) == batch.column("s1").to_numpy()
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(made.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), held], ["rep", "set"]).filter(pa.array(right))

    found = durable(rows.mapInArrow(run, "rep bigint, set array<bigint>"), "sets")
    return found if found.count() == wanted.count() else durable(found.dropDuplicates(["rep"]), "sets")


def _fits(a: str, b: str, share: int) -> Column:
    """Whether nodes may hold a linked pair: by sizes, then by the bits that their sizes need in common.

    Linked sets of n and m shingles share at least share / (100 + share) of
    n + m. At most n less that are not shared, so of the bits of the one at
    most as many are not bits of the other.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    sizes = (100 * col(a, "most") >= share * col(b, "least")) & (100 * col(b, "most") >= share * col(a, "least"))
    overlap = F.ceil(share * (col(a, "least") + col(b, "least")) / (100 + share) - 1e-9)
    need = F.greatest(col(a, "low"), col(b, "low")) + overlap
    both = F.aggregate(
        F.zip_with(col(a, "bits"), col(b, "bits"), lambda x, y: F.bit_count(x.bitwiseAND(y))),
        F.lit(0), lambda s, x: s + x,
    )
    return sizes & ((need <= 0) | (both >= need))


def _apart(a: str, b: str) -> Column:
    """Whether nodes hold members of different components."""
    return (F.col(f"{a}.r0") != F.col(f"{a}.r1")) | (F.col(f"{b}.r0") != F.col(f"{b}.r1")) | (F.col(f"{a}.r0") != F.col(f"{b}.r0"))


def _left(a: str, b: str) -> Column:
    """Whether an earlier group holds all members of both nodes, so that their pairs are left to it."""
    return F.arrays_overlap(F.col(f"{a}.earlier"), F.col(f"{b}.earlier"))


def fitting(pairs: DataFrame, marks: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs (a, b) that neither their sizes nor their bitmaps in ``marks`` (rep, n, low, bits) rule out."""
    node = marks.select(F.col("rep").alias("at"), F.col("n").alias("least"), F.col("n").alias("most"), "low", "bits")
    left, right = node.alias("x"), node.alias("y")
    fit = pairs.join(left, F.col("a") == F.col("x.at")).join(right, F.col("b") == F.col("y.at")).filter(_fits("x", "y", share))
    return durable(fit.select("a", "b"), "fitting")


def compared(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs (a, b) with ``linked``, by their whole sets (rep, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            (oa, va), (ob, vb) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in (batch.column("sa"), batch.column("sb")))
            for i in range(batch.num_rows):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                found[i] = 100 * both >= share * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "linked"])

    whole = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    whole = whole.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")
    return whole.mapInArrow(run, "a bigint, b bigint, linked boolean")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (key, rep, n) with their component, of groups that are of more than one."""
    rows = members.withColumn("root", F.col("rep"))
    if roots is not None:
        rows = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rows = durable(rows.select("key", "rep", "n", "root"), "members")
    mixed = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    return durable(rows.join(mixed.select("key"), "key", "left_semi"), "mixed")


def _earlier(members: DataFrame, known: int = EARLIER) -> DataFrame:
    """Members with ``earlier``: the largest ``known`` groups of those it is in, too, that come before this one.

    One order holds for all groups. The first group that two members have in
    common is earlier for neither in that group, so nothing is left to none.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    of_rep = Window.partitionBy("rep").orderBy(F.desc("size"), "key")  # as many rows as a text has first shingles
    ranked = members.join(sizes, "key").withColumn("place", F.row_number().over(of_rep))
    before = of_rep.rowsBetween(Window.unboundedPreceding, -1)
    found = F.collect_list(F.when(F.col("place") <= known, F.col("key"))).over(before)
    return ranked.withColumn("earlier", found).drop("size", "place")


def _levels(members: DataFrame, marks: DataFrame, fan: int) -> list[DataFrame]:
    """The nodes of all trees by level, the members first: key, node, least, most, low, r0, r1, earlier, bits.

    Components are r0 to r1; ``earlier`` holds the earlier groups that all members know.
    """
    # Groups lie side by side in one order, by sizes about a fourth apart; nodes are gapless numbers cut into parents.
    near_size = F.floor(3 * F.log2("n"))
    placed = ordered.number(_earlier(members), ["key", near_size, "earlier", "root", "n", "rep"], "node")
    level = durable(placed.join(marks.select("rep", "low", "bits"), "rep").select(
        "key", "node", "rep", F.col("n").alias("least"), F.col("n").alias("most"), "low", F.col("root").alias("r0"),
        F.col("root").alias("r1"), "earlier", "bits"), "nodes")
    levels = [level]
    while not level.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").isEmpty():
        in_all = F.aggregate(F.collect_list("earlier"), F.first("earlier"), F.array_intersect)
        ored = F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(BITMAP)])
        level = durable(level.groupBy("key", F.expr(f"node div {fan}").alias("node")).agg(
            F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"),
            F.min("r0").alias("r0"), F.max("r1").alias("r1"), in_all.alias("earlier"), ored.alias("bits")), "nodes")
        levels.append(level)
    return levels


def traversed(members: DataFrame, marks: DataFrame, share: int = SHARE, fan: int = FAN) -> DataFrame:
    """Pairs (a, b) of members (key, rep, n, root) of different components that no node of their trees rules out."""
    levels = _levels(members, marks, fan)
    pairs = levels[-1].filter("r0 < r1 and size(earlier) = 0").select("key", F.col("node").alias("p"), F.col("node").alias("q"))
    for level in reversed(levels[:-1]):
        above = level.withColumn("parent", F.expr(f"node div {fan}"))
        x, y = above.alias("x"), above.alias("y")
        down = pairs.alias("pair").join(x, (F.col("pair.key") == F.col("x.key")) & (F.col("p") == F.col("x.parent")))
        down = down.join(y, (F.col("pair.key") == F.col("y.key")) & (F.col("q") == F.col("y.parent")))
        self_pair = F.col("x.node") == F.col("y.node")
        if level is levels[0]:
            kept = down.filter((F.col("x.node") < F.col("y.node")) & _apart("x", "y") & ~_left("x", "y") & _fits("x", "y", share))
            pairs = kept.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
        else:
            kept = down.filter((F.col("x.node") <= F.col("y.node")) & _apart("x", "y") & ~_left("x", "y") & (self_pair | _fits("x", "y", share)))
            pairs = kept.select(F.col("pair.key").alias("key"), F.col("x.node").alias("p"), F.col("y.node").alias("q"))
        pairs = durable(pairs, "node-pairs")
    return pairs


def _met(members: DataFrame, parts: int, share: int = SHARE) -> DataFrame:
    """Pairs (a, b): members (key, rep, n, root) with the first of their group, or of up to ``parts`` parts of it.

    Copies are together in many groups, and the same few are first in most. With
    parts, a pair is therefore met in its first common group only, as far as
    ``earlier`` tells; what does not meet at all is left to the traversal.
    """
    meeting = members.withColumn("parts", F.lit(1)).withColumn("earlier", F.array().cast("array<bigint>"))
    if parts > 1:  # in a small group all would meet all: the traversal does that
        held = members.groupBy("key").agg(F.least(F.lit(parts), F.expr(f"count(1) div {parts}")).alias("parts"))
        meeting = durable(_earlier(members.join(held.filter("parts > 1"), "key")), "meeting")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")
    carried = ("rep", "root", "n", "earlier")
    leads = meeting.groupBy("key", part).agg(F.min(F.struct(*carried)).alias("lead")).select(
        "key", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in carried])
    sizes = (100 * F.col("n") >= share * F.col("lead_n")) & (100 * F.col("lead_n") >= share * F.col("n"))
    first = ~F.arrays_overlap("earlier", "lead_earlier")
    met = meeting.join(leads, "key").filter((F.col("root") != F.col("lead_root")) & sizes & first)
    return met.select(F.greatest("rep", "lead_rep").alias("a"), F.least("rep", "lead_rep").alias("b"))


def linked(
    members: DataFrame, reps: DataFrame, docs: DataFrame, share: int = SHARE, width: int = WIDTH,
    parts: int = PARTS, fan: int = FAN,
) -> DataFrame | None:
    """(node, root) of all members (key, rep, n) of groups that have a link; root is their component.

    ``reps`` is a stored table of (rep, doc, n, s0, s1, low, bits) for all members.
    """
    roots, links, done, sets = None, None, None, None
    for firsts in (1, parts, 0):
        mixed = _rooted(members, roots)
        if mixed.isEmpty():
            return roots
        if firsts:
            pairs = _met(mixed, firsts, share).distinct()
            pairs = fitting(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), reps, share)
        else:
            pairs = traversed(mixed, reps, share, fan)
            pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        if sets is not None:
            asked = asked.join(sets.select("rep"), "rep", "left_anti")
        wanted = durable(reps.select("rep", "doc", "s0", "s1").join(asked, "rep", "left_semi"), "wanted")
        if not wanted.isEmpty():
            fresh = full_sets(wanted, docs, width)
            sets = fresh if sets is None else sets.unionByName(fresh)
        if sets is None:
            continue
        found = durable(compared(pairs, sets, share), "compared")
        done = found.select("a", "b") if done is None else done.unionByName(found.select("a", "b"))
        fresh = found.filter("linked").select("a", "b")
        if not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            roots = components(links)
    return roots


def linked_documents(
    docs: DataFrame, share: int = SHARE, width: int = WIDTH, common: int = COMMON, parts: int = PARTS, fan: int = FAN
) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set) and component_id, the smallest doc_id reachable by links.

    Two rows are linked when their sets share ``share`` of 100 or more of all
    their shingles. A text without words, or a null one, has an empty set and is
    linked with nothing. A row without doc_id takes no part; its component_id is
    null. Rows of one doc_id are documents of their own.
    """
    short_batches(docs.sparkSession)
    rows = durable(set_rows(docs, common_shingles(docs, least=common, width=width), share, width), "sets")
    good = rows.filter("n > 0 and doc_id is not null")
    reps = good.groupBy("n", "s0", "s1").agg(F.min("doc_id").alias("doc"), F.first(F.struct("first", "low", "bits")).alias("x"))
    # The numbers are fixed by being written.
    reps = durable(reps.select(F.monotonically_increasing_id().alias("rep"), "doc", "n", "s0", "s1", "x.*"), "reps")
    each = durable(rows.select("doc_id", "n", "s0", "s1"), "documents")
    discard(rows)
    keys = durable(shared(reps.select("rep", F.posexplode("first").alias("at", "key"))), "shared")
    members = groups_of(keys, reps, share)
    involved = durable(reps.drop("first").join(members.select("rep").distinct(), "rep", "left_semi"), "involved")
    named = durable(reps.select("rep", "doc", "n", "s0", "s1"), "representatives")
    discard(reps)
    discard(keys)
    roots = linked(members, involved, docs, share, width, parts, fan)
    if roots is not None:
        least = named.join(roots, F.col("rep") == F.col("node")).groupBy("root").agg(F.min("doc").alias("low"))
        lowest = durable(roots.join(least, "root").select(F.col("node").alias("rep"), "low"), "lowest")
        named = named.join(lowest, "rep", "left").withColumn("doc", F.coalesce("low", "doc"))
    named = named.select("n", "s0", "s1", F.col("doc").alias("component"))
    found = each.join(named, ["n", "s0", "s1"], "left")
    lone = F.col("doc_id").isNull() | F.col("component").isNull()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )
