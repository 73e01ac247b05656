"""Classes of near-duplicate documents by DartMinHash signatures.

1. Every text becomes a weighted set of word shingles, its signature of darts,
   and one key per band of the signature. Equal texts are one representative
   from here on, so a thousand copies cost one signature. Representatives have
   numbers of their own: a doc_id may stand for several texts, or come twice.
2. Representatives that share a band key are a bucket. Bucket members are
   compared with one leader, the lowest id: no pairs within a bucket.
3. Compared means exact: the weighted Jaccard similarity of the two texts.
4. Members a leader did not reach may still be linked with one another, so
   buckets that are not one component yet go on. Distances to the leader rule
   members out: similarity 0.8 is a Jaccard distance of 0.2, and the triangle
   inequality holds for it. The others are regrouped by their rarest shingles:
   two texts that are similar to 0.8 share one of the rarest fifth of either's,
   whatever else they have in common. Texts with many edits of their own fall
   into no group at all, without any pair of them being looked at. Groups meet
   ever more leaders until every pair in them is compared or connected.
5. Links give components, each named by the lowest doc_id of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import darts
from cairn.llm.common import free_name, likely, short_batches, small_batches
from cairn.session import durable

SIMILARITY = 0.8
#: 48 bands of 7: a pair at 0.8 is missed by all bands with a chance of 1.2e-5.
BANDS, ROWS = 48, 7
BATCH_BYTES = 1 << 19
GROWTH = 64


def text_hashes(texts: pa.Array) -> np.ndarray:
    """128-bit hash of every text, as two words."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode()) for t in texts.to_pylist()), np.int64).reshape(-1, 2)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = darts.WORDS) -> DataFrame:
    """Per document with a text: doc_id, text hash (t0, t1), band keys (empty without words)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                texts = batch.column("text")
                elements, doc = darts.shingles(texts, powers, width)
                n = batch.num_rows
                keys = darts.band_keys(darts.signatures(elements, doc, n, bands * rows), bands)
                filled = np.bincount(doc, minlength=n) > 0 if len(doc) else np.zeros(n, bool)
                ends = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
                hashes = text_hashes(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[filled].ravel()))],
                    ["doc_id", "t0", "t1", "bands"],
                )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("t0", T.LongType()), T.StructField("t1", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    good = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return docs.filter(good).select("doc_id", "text").mapInArrow(run, schema)


def similarities(pairs: DataFrame, texts: DataFrame, width: int = darts.WORDS) -> DataFrame:
    """Pairs (a, b) with ``sim``, the weighted Jaccard similarity of their texts' shingles.

    The text of ``b`` comes first, then that of ``a``: both are plain joins
    that can be split where one document is in very many pairs.
    """
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    kind = texts.schema["rep"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, ("ta", "tb"), BATCH_BYTES):
                n = batch.num_rows
                both = pa.concat_arrays([batch.column("ta"), batch.column("tb")])
                elements, doc = darts.shingles(both, powers, width)
                at = np.searchsorted(doc, np.arange(2 * n + 1))
                found = np.zeros(n)
                for i in range(n):
                    x, y = elements[at[i]:at[i + 1]], elements[at[n + i]:at[n + i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    found[i] = common / max(1, len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "sim"]
                )

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("sim", T.DoubleType())])
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the lowest node it is connected with.

    Large-star and small-star rounds: each node hands its neighbours its lowest
    neighbour, until all links are stars around the lowest nodes. Rounds grow
    with the logarithm of the longest chain. Each is written down, so nothing
    is recomputed and a lost executor costs one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = durable(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lower, "u").select(F.explode(to_low).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = durable(small, "links")
        # Stars: no node that others hang on hangs on another, and none hangs on two.
        inner = edges.select(F.col("v").alias("u")).distinct()
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        if edges.join(inner, "u", "left_semi").select("u").unionByName(twice).isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component ``root``; a document without links is its own."""
    named = roots.select(F.col("node").alias("rep"), "root")
    return members.join(named, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def rare_elements(texts: DataFrame, similarity: float, width: int = darts.WORDS) -> DataFrame:
    """Of each text (rep, text) the rarest elements, enough that similar texts share one.

    Of n elements those are the n - ceil(similarity * n) + 1 that the fewest of
    these texts have. Elements of one text only are left out then: nobody
    shares them. Columns: rep, key, n and most, the largest partner in question
    when this is the first element that both have: those passed over are not
    shared, and what remains must make up the similarity.
    """
    kind = texts.schema["rep"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = darts.Powers()
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                elements, doc = darts.shingles(batch.column("text"), powers, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(pa.array(doc)), pa.array(elements.view(np.int64))], ["rep", "key"]
                )

    schema = T.StructType([T.StructField("rep", kind), T.StructField("key", T.LongType())])
    every = durable(texts.select("rep", "text").mapInArrow(run, schema), "elements")
    held = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sorted_ = every.join(held, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    size = F.size("all")
    first = (size - F.ceil(size * F.lit(similarity) - 1e-9) + 1).cast("int")
    rare = sorted_.select("rep", size.alias("n"), F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "x"))
    share = similarity / (1 + similarity)
    most = F.floor((F.col("n") - F.col("at")) / F.lit(share) - F.col("n") + 1e-6).cast("int")
    return rare.filter("x.n > 1").select("rep", F.col("x.key").alias("key"), "n", most.alias("most"))


def _partnered(rows: DataFrame) -> DataFrame:
    """Rows of a group that has a member small enough to be a partner."""
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    return durable(rows.join(least, "key").filter("least <= most").drop("least"), "partnered")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of groups that are of more than one component."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    return durable(rows.join(mixed.select("key"), "key"), "groups")


def texts_of(wanted: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rep, text), one row for each of wanted (rep, doc, t0, t1).

    A document's one row is found by its id. Ids that documents share
    (``repeated``, a stored table) are told apart by their text: equal rows are
    put together before they are shuffled, the others hashed once more. A filter
    of fixed size holds back texts that are not wanted.
    """
    rows = likely(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id", wanted.select("doc"))
    if repeated.isEmpty():
        return rows.join(wanted.select("rep", F.col("doc").alias("doc_id")), "doc_id").select("rep", "text")
    several = repeated.select("doc_id")
    named = wanted.withColumnRenamed("doc", "doc_id")
    once = rows.join(named.join(several, "doc_id", "left_anti").select("rep", "doc_id"), "doc_id").select("rep", "text")
    asked = named.join(several, "doc_id", "left_semi")
    each = rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                hashes = text_hashes(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], ["doc_id", "text", "t0", "t1"]
                )

    schema = T.StructType([*each.schema.fields, T.StructField("t0", T.LongType()), T.StructField("t1", T.LongType())])
    found = each.mapInArrow(run, schema).join(asked, ["doc_id", "t0", "t1"])
    return once.unionByName(found.select("rep", "text"))


def linked(reps: DataFrame, docs: DataFrame, repeated: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of all representatives (rep, doc, t0, t1, bands) with a similar one; root is their class.

    ``reps`` must be a stored table with one row per distinct text, ``doc`` a
    document that has it, and ``repeated`` one of the doc_ids of several rows.
    """
    reach = 1.0 - similarity + 1e-9
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = durable(
        banded.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets"
    )
    members = durable(banded.join(buckets, "key").select("key", "rep", "lead"), "members")
    involved = members.select("rep").distinct()
    wanted = durable(reps.select("rep", "doc", "t0", "t1").join(involved, "rep", "left_semi"), "involved")
    texts = durable(texts_of(wanted, docs, repeated), "texts")
    asked = members.filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    sims = durable(similarities(asked, texts), "similarities")
    links = sims.filter(F.col("sim") >= similarity).select("a", "b")
    roots = components(links)
    far = sims.select(F.col("a").alias("rep"), F.col("b").alias("lead"), (1 - F.col("sim")).alias("far"))
    known = _labelled(members.join(far, ["rep", "lead"]), roots)  # leaders have met all others
    ends = known.groupBy("key").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"),
        F.min(F.when(F.col("far") > reach, F.col("far"))).alias("least_far"),
    ).filter("r0 < r1")
    near = F.col("far") > F.coalesce(F.col("least_far"), F.lit(0.0)) - reach
    left = durable(known.join(ends, "key").filter(near).select("rep").distinct(), "left")
    if left.isEmpty():
        return roots
    rest = texts.join(left, "rep", "left_semi")
    groups = durable(rare_elements(rest, similarity), "groups")
    parts = GROWTH
    while True:
        known = _mixed(_partnered(_labelled(groups, roots)))
        if known.isEmpty():
            return roots
        part = F.pmod(F.xxhash64("rep"), F.lit(parts))
        leaders = durable(
            known.groupBy("key", part.alias("part")).agg(F.min(F.struct("rep", "root", "n", "most")).alias("x"))
            .select("key", *[F.col(f"x.{c}").alias(f"lead_{c}") for c in ("root", "n", "most")], F.col("x.rep").alias("lead")),
            "leaders",
        )
        fit = (F.col("n") <= F.col("lead_most")) & (F.col("lead_n") <= F.col("most"))
        met = known.join(leaders, "key").filter((F.col("root") != F.col("lead_root")) & fit)
        asked = met.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct()
        asked = asked.join(sims.select("a", "b"), ["a", "b"], "left_anti")
        found = durable(similarities(asked, texts), "similarities")
        fresh = found.filter(F.col("sim") >= similarity).select("a", "b")
        sims = sims.unionByName(found)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            roots = components(links)
        used = leaders.select("key", F.col("lead").alias("rep"))
        groups = known.drop("root").join(used, ["key", "rep"], "left_anti")
        parts *= GROWTH


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id and class_id, the lowest doc_id of its near-duplicate class.

    Equal texts are of one class, empty ones too. A null text or doc_id is a
    class of its own (class_id is then the doc_id). Texts of fewer than five
    words have one shingle. Rows that share a doc_id are one document and
    share a class.
    """
    short_batches(docs.sparkSession)
    rows = durable(sketch(docs), "sketch")
    texts = rows.groupBy("t0", "t1").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    # The numbers are fixed by being written.
    texts = durable(texts.select(F.monotonically_increasing_id().alias("rep"), "doc", "t0", "t1", "bands"), "copies")
    copies = rows.join(texts.select("t0", "t1", "rep", "doc"), ["t0", "t1"]).select("doc_id", "rep", "doc")
    repeated = copies.groupBy("doc_id").agg(
        F.min("rep").alias("b"), F.max("rep").alias("c"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    repeated = durable(repeated.select("doc_id", "b", "c"), "repeated")
    roots = linked(texts, docs, repeated, similarity)
    # A doc_id with several texts ties their classes together.
    several = repeated.filter("b < c").select("doc_id", "b")
    ties = durable(copies.join(several, "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct(), "ties")
    if not ties.isEmpty():
        roots = components(ties.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    least = texts.select("rep", "doc").join(roots, F.col("rep") == F.col("node")).groupBy("root").agg(F.min("doc").alias("low"))
    lowest = durable(roots.join(least, "root").select("node", "low"), "lowest")
    named = copies.join(lowest, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.coalesce("low", "doc").alias("class_id")
    ).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document of lowest doc_id of each class, with all columns; see ``classes``.

    Only the ids that go meet the documents, in an anti join.
    """
    gone = free_name(docs, "_gone")
    found = classes(docs.select("doc_id", "text"), similarity)
    dropped = durable(found.filter("class_id < doc_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")
