"""Lines that many documents share, dropped by probing a sharded perfect hash.

1. Every document gives its distinct long lines as 128-bit hashes (two longs),
   written once. Counts are combined before the shuffle.
2. Lines found in enough documents are dealt into shards by hash, so a shard
   holds a bounded number of keys. Each shard becomes one row of arrays: the
   pilots of a minimal perfect hash, and at each slot the fingerprint, the
   number of documents and the largest document id.
3. Hashes probe the arrays of their shard: bucket, pilot, slot, then compare
   the fingerprint. The join key is the shard, not the line, so a line found
   in a third of all documents is no hot key of its own, and a large shard
   partition can be split at will.
4. What is dropped goes back to the documents by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import free_name, small_batches
from cairn.session import durable

MIN_DOCS = 3
MIN_CHARS = 20
SHARD_KEYS = 16_384
LEAST_SHARDS = 64
BUCKET_KEYS = 4
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Fixed values of the 64-bit xxHash, which Spark's xxhash64 evaluates on longs.
PRIME1, PRIME2, PRIME3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
PRIME4, PRIME5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def hash_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """What Spark's xxhash64 makes of a long, from a seed."""
    u = np.uint64
    rotl = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    state = np.atleast_1d(np.asarray(seed, np.uint64)) + u(PRIME5 + 8)
    state = state ^ (rotl(value.view(np.uint64) * u(PRIME2), 31) * u(PRIME1))
    state = rotl(state, 27) * u(PRIME1) + u(PRIME4)
    state = (state ^ (state >> u(33))) * u(PRIME2)
    state = (state ^ (state >> u(29))) * u(PRIME3)
    return state ^ (state >> u(32))


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).translate(LOWER)


def _chars(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _hashes(line: bytes, least: int) -> tuple[int, int] | None:
    key = line_key(line)
    if len(key) < least or _chars(key) < least:
        return None
    two = xxhash.xxh3_128_digest(key)
    return int.from_bytes(two[:8], "little", signed=True), int.from_bytes(two[8:], "little", signed=True)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and distinct long line: doc_id, h, f. Null text has no such line."""
    kind = docs.schema["doc_id"].dataType

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text"):
                rows, h, f = [], [], []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    found = {_hashes(x, min_chars) for x in (text or "").encode().split(b"\n")} - {None}
                    rows += [at] * len(found)
                    h += [x[0] for x in found]
                    f += [x[1] for x in found]
                ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(h, pa.int64()), pa.array(f, pa.int64())], ["doc_id", "h", "f"]
                )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("h", T.LongType()),
                           T.StructField("f", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(lines, schema)


def common_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines of at least ``min_docs`` documents: h, f, n, last (largest doc_id)."""
    return (
        hashes.groupBy("h", "f")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= min_docs)
    )


def perfect_hash(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots per bucket and the slot of each key: a bijection onto 0..n-1.

    Buckets with several keys try pilots 0, 1, ... until all their keys fall on
    free slots, the fullest buckets first. Buckets of one key take what is left
    and store the slot itself as a negative pilot.
    """
    n = len(h)
    buckets = max(1, -(-n // BUCKET_KEYS))
    mixed = h ^ f
    bucket = np.mod(mixed, buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    pilots, slots = np.full(buckets, -1, np.int64), np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    sizes = np.diff(starts)
    seeds = hash_long(h, 42)
    tries = np.arange(256, dtype=np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[starts[b]:starts[b + 1]]
        low = 0
        while True:
            drawn = hash_long((low + tries)[:, None] ^ f[own][None, :], seeds[own][None, :])
            spots = np.mod(drawn.view(np.int64), n)
            free = ~taken[spots].any(axis=1)
            ranked = np.sort(spots, axis=1)
            free &= (np.diff(ranked, axis=1) != 0).all(axis=1)
            if free.any():
                hit = int(np.argmax(free))
                pilots[b], slots[own] = low + hit, spots[hit]
                taken[spots[hit]] = True
                break
            low += len(tries)
    left = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(sizes == 1):
        own, spot = order[starts[b]], next(left)
        pilots[b], slots[own] = -spot - 1, spot
    return pilots, slots


def build_shards(common: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard: pilots, fingerprints, counts and last ids as arrays.

    The number of shards follows the number of keys, so that a shard stays near
    ``shard_keys`` keys; they are spread by hash. Pass a stored table: its rows
    are counted first.
    """
    shards = max(LEAST_SHARDS, -(-common.count() // shard_keys))
    kind = common.schema["last"].dataType
    array = lambda k: T.ArrayType(k, True)
    schema = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("shards", T.LongType())]
        + [T.StructField(n, array(T.LongType())) for n in ("pilots", "prints", "counts")]
        + [T.StructField("lasts", array(kind))]
    )

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pilots, slots = perfect_hash(part["h"].to_numpy(), part["f"].to_numpy())
        place = np.argsort(slots)
        one = {"shard": key[0], "shards": shards, "pilots": pilots}
        one |= {to: part[of].to_numpy()[place] for to, of in (("prints", "f"), ("counts", "n"), ("lasts", "last"))}
        return pd.DataFrame({k: [v] for k, v in one.items()})

    placed = common.withColumn("_shard", F.pmod("h", F.lit(shards)))
    return placed.groupBy("_shard").applyInPandas(build, schema)


def _slot(size: Column) -> Column:
    """Slot of (h, f) in a shard of ``size`` keys, as ``perfect_hash`` placed it."""
    mixed = F.col("h").bitwiseXOR(F.col("f"))
    pilot = F.get("pilots", F.pmod(mixed, F.size("pilots").cast("bigint")).cast("int"))
    drawn = F.pmod(F.xxhash64(F.col("h"), pilot.bitwiseXOR(F.col("f"))), size.cast("bigint"))
    return F.when(pilot < 0, -pilot - 1).otherwise(drawn).cast("int")


def probe(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``hashes`` whose line is in the index, with its count ``n`` and ``last`` document.

    The join hands a row the arrays of its shard; two array reads find the
    line. Whether the shards are broadcast is the planner's choice by their
    written size.
    """
    shards = index.agg(F.max("shards")).first()[0]
    if shards is None:
        return hashes.limit(0).select("*", F.lit(0).cast("bigint").alias("n"), F.col("doc_id").alias("last"))
    at = hashes.withColumn("shard", F.pmod("h", F.lit(shards)))
    found = at.join(index, "shard").withColumn("_slot", _slot(F.size("prints")))
    return found.filter(F.get("prints", F.col("_slot")) == F.col("f")).select(
        *hashes.columns, F.get("counts", F.col("_slot")).alias("n"), F.get("lasts", F.col("_slot")).alias("last")
    )


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per doc_id that loses lines: ``gone``, the hashes of those lines as (h, f)."""
    hashes = durable(line_hashes(docs, min_chars), "line-hashes")
    common = durable(common_lines(hashes, min_docs), "common-lines")
    index = durable(build_shards(common), "line-shards")
    lost = probe(hashes, index).filter((F.col("n") >= min_docs) & (F.col("doc_id") != F.col("last")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h", "f")).alias("gone"))


def _split(text: str | None, gone: list[dict] | None, least: int) -> tuple[int, list[bytes]]:
    lines = (text or "").encode().split(b"\n")
    if gone is None or len(gone) == 0:
        return len(lines), lines
    lost = {(x["h"], x["f"]) for x in gone}
    return len(lines), [x for x in lines if _hashes(x, least) not in lost]


def _with_gone(docs: DataFrame, name: str, min_docs: int, min_chars: int) -> DataFrame:
    """The documents with ``name``, the hashes of the lines they lose or null."""
    doc = free_name(docs, "_doc")
    gone = shared_lines(docs.select("doc_id", "text"), min_docs, min_chars).toDF(doc, name)
    return docs.join(gone, F.col("doc_id") == F.col(doc), "left").drop(doc)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with every common line kept in the largest doc_id only.

    A document is a row: repeated rows count as documents of their own and are
    treated alike. A null text stays null, a null doc_id keeps all its lines.
    Documents that lose nothing come back as they were; one that loses all its
    lines has an empty text. A column ``n_chars``, if there is one, follows the
    new text. All other columns are passed through.
    """
    gone = free_name(docs, "_gone")
    rows = _with_gone(docs, gone, min_docs, min_chars)
    kinds = docs.schema
    counts = [f.name for f in kinds if f.name == "n_chars"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text"):
                texts, sizes = [], []
                lost = batch.column(gone).to_pylist()
                for text, own in zip(batch.column("text").to_pylist(), lost):
                    if own is not None and text is not None:
                        text = b"\n".join(_split(text, own, min_chars)[1]).decode("utf-8", "replace")
                    texts.append(text)
                    sizes.append(None if text is None else len(text))
                new = {"text": pa.array(texts, pa.string())}
                for name in counts:
                    old = batch.column(name)
                    changed = pa.array([x is not None for x in lost])
                    new[name] = pc.if_else(changed, pa.array(sizes, pa.int64()).cast(old.type), old)
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in kinds.names], kinds.names)

    return rows.select(*docs.columns, gone).mapInArrow(strip, kinds)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines before dropping, n_dropped, kept_sha256.

    A null or empty text is one empty line, which is never long enough to drop.
    """
    kind = docs.schema["doc_id"].dataType
    rows = _with_gone(docs.select("doc_id", "text"), "gone", min_docs, min_chars)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text"):
                total, lost, digest = [], [], []
                for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                    n, kept = _split(text, gone, min_chars)
                    total.append(n)
                    lost.append(n - len(kept))
                    digest.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
                     pa.array(digest, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
                )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return rows.mapInArrow(report, schema)
