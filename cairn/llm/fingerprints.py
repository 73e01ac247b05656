"""Document fingerprints: bottom-k sketches of word shingles, as plain Columns.

A sketch is the sorted array of the k lowest distinct hashes of a text's
shingles. Sketches of parts merge into the sketch of the whole. Two of them
estimate resemblance and containment, one alone the number of distinct
shingles. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import free_name, text_or_empty
from cairn.operators.ordered import number

K = 64
WIDTH = 5
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of other than ASCII blanks."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the sketch of a text column that has no nulls.

    A text of fewer words than ``width`` has one shingle, a text without words
    an empty sketch. Steps are columns of their own so that each is computed
    once.
    """
    words, hashes = free_name(df, "_words"), free_name(df, "_hashes")
    each = F.col(words)
    shingle = lambda w, i: F.xxhash64(w, *[F.get(each, i + n) for n in range(1, width)])
    size = F.size(each)
    made = F.when(size >= width, F.transform(F.slice(each, F.lit(1), F.greatest(size - width + 1, F.lit(0))), shingle))
    made = made.when(size > 0, F.array(F.xxhash64(F.array_join(each, " ")))).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumn(words, words_of(F.col(text))).withColumn(hashes, made)
    return rows.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words, hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, keys: Sequence[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of all rows of each key. Each task passes on k hashes of a key at most."""
    lowest = Window.partitionBy(*keys).orderBy("_hash")
    hashes = df.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    kept = hashes.withColumn("_rank", F.row_number().over(lowest)).filter(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two texts' shingles; two empty sketches are alike."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact where the sketch is not full."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; an empty a is contained in anything."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def written(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def successors(docs: DataFrame) -> DataFrame:
    """doc_id and next_id: the next larger doc_id there is, after the largest the smallest. A null id is the smallest."""
    ids = number(docs.select("doc_id").distinct(), [F.col("doc_id").asc_nulls_first()], "_pos")
    size = ids.agg(F.max("_pos") + 1).first()[0] or 1
    after = ids.select(F.col("doc_id").alias("next_id"), F.col("_pos").alias("_next"))
    return ids.withColumn("_next", (F.col("_pos") + 1) % F.lit(size)).join(after, "_next").select("doc_id", "next_id")


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, the two fingerprints and their likeness to others.

    The edited text is the text with its last quarter of code points replaced by
    the first as many of the next document. A null text is an empty one. Where
    rows share a doc_id, each is edited with the same next document: of the rows
    of that id, the one whose needed beginning sorts first. Texts are shuffled
    once by id; only the needed beginnings move a second time.
    """
    # Ids as text, a null one too, so that both uses of the shuffled texts are one and the same plan.
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit(""))
    doc_id = F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 20)).cast(docs.schema["doc_id"].dataType)
    rows = docs.select(key("doc_id").alias("_key"), text_or_empty().alias("text"))
    placed = with_sketch(rows, "text", "sketch", k).repartition("_key")
    needs = docs.groupBy("doc_id").agg(F.max(F.floor(F.length(text_or_empty()) / 4)).alias("_need"))
    wanted = successors(docs).withColumn("_of", key("doc_id")).withColumn("_from", key("next_id"))
    needs = needs.select(key("doc_id").alias("_of"), "_need")
    wanted = wanted.select("_of", "_from").join(needs, "_of")
    heads = placed.join(wanted, F.col("_key") == F.col("_from")).groupBy("_of").agg(
        F.min(F.struct(F.left("text", F.col("_need").cast("int")).alias("head"), F.col("sketch").alias("next"))).alias("_n")
    ).select("_of", "_n.head", "_n.next")
    pairs = placed.join(heads, F.col("_key") == F.col("_of"))
    chars = F.length("text")
    quarter = F.floor(chars / 4).cast("int")
    edited = F.concat(F.left("text", chars - quarter), F.left("head", quarter))
    both = pairs.select(doc_id.alias("doc_id"), chars.cast("bigint").alias("n_chars"), "sketch", "next", edited.alias("edited"))
    both = with_sketch(both, "edited", "changed", k)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next"), k).alias("near_next"),
    )
