"""Language of a text by n-grams in one bit-sliced Bloom filter.

Every language keeps its frequent byte n-grams in a Bloom filter of its own.
The filters are laid side by side: row r of the table holds bit r of all of
them, in as many words as the languages need, so a few row reads joined by AND
give the bitmask of all languages that contain an n-gram. The set bits of each language are counted over a text, the
counts are corrected for what the filter's false positives add, and the
language with the highest corrected count is the answer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches

#: Bytes of an n-gram, rows of the filter, rows read per n-gram.
SIZES, ROWS, READS = (3, 5), 1 << 18, 3
#: About so many texts are learned from per language, those of lowest hashed doc_id.
TRAIN_TEXTS = 4_000
#: An n-gram belongs to a language when so large a share of its texts have it, the most frequent ones first.
LEAST_SHARE, LANGUAGE_GRAMS = 0.01, 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 19
UNKNOWN = "und"

#: Bytes that count: letters as they are, all other ASCII as a blank.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram of lower-cased texts, and the text it stands in. Runs of blanks give none."""
    lowered = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset:lowered.offset + len(lowered) + 1]
    size = int(offsets[-1] - offsets[0]) if len(lowered) else 0
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = FOLD[np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    doc = np.repeat(np.arange(len(lowered)), np.diff(offsets))
    wide = raw.astype(np.uint64)
    hashes, owners = [], []
    for n in SIZES:
        if size < n:
            continue
        word = np.zeros(size - n + 1, np.uint64)
        for k in range(n):
            word |= wide[k:size - n + 1 + k] << np.uint64(8 * k)
        good = doc[:size - n + 1] == doc[n - 1:]
        good &= ~((raw[:size - n + 1] == 32) & (raw[1:size - n + 2] == 32))
        word = (word[good] + np.uint64(n)) * MIX
        hashes.append(word ^ (word >> np.uint64(29)))
        owners.append(doc[:size - n + 1][good])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def rows_of(hashes: np.ndarray, rows: int, read: int) -> np.ndarray:
    """Row of an n-gram for one of its reads."""
    mixed = (hashes + np.uint64((read + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) * MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
    return ((mixed >> np.uint64(32)) * np.uint64(rows)) >> np.uint64(32)


#: Languages in a word of a table row.
WORD = 64


@dataclass
class Filter:
    """The bit-sliced table, its languages, the false-positive rate of each, and the answer without evidence."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray
    fallback: int

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Row of every n-gram for each of its reads."""
        return [rows_of(hashes, len(self.table), read) for read in range(READS)]

    def masks(self, hashes: np.ndarray, word: int = 0, places: list[np.ndarray] | None = None) -> np.ndarray:
        """Per n-gram which of the languages of a word contain it, one bit each."""
        first, *others = self.places(hashes) if places is None else places
        column = self.table[:, word]
        found = column[first]
        for place in others:
            found &= column[place]
        return found

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts, texts by languages, and the number of n-grams of each text."""
        hashes, doc = grams(texts)
        places = self.places(hashes)
        total = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        found = np.zeros((len(texts), len(self.languages)))
        kind = self.table.dtype.type
        for at in range(len(self.languages)):
            word, bit = divmod(at, WORD)
            if bit == 0:
                masks = self.masks(hashes, word, places)
            own = (masks >> kind(bit)) & kind(1)
            hits = np.bincount(doc, weights=own, minlength=len(texts)) if len(doc) else 0.0
            found[:, at] = (hits - total * self.wrong[at]) / (1.0 - self.wrong[at])
        return np.maximum(found, 0.0), total


def build(kept: dict[str, np.ndarray], texts: dict[str, int], rows: int = ROWS) -> Filter:
    """A filter from the n-grams of each language; a row has a word for every 64 languages."""
    languages = sorted(kept)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), WORD) <= 8 * np.dtype(k).itemsize)
    table = np.zeros((rows, max(1, -(-len(languages) // WORD))), kind)
    wrong = np.zeros(len(languages))
    for at, language in enumerate(languages):
        own = np.zeros(rows, bool)
        for read in range(READS):
            own[rows_of(kept[language], rows, read)] = True
        word, bit = divmod(at, WORD)
        table[own, word] |= kind(1 << bit)
        wrong[at] = own.mean() ** READS
    most = max(range(len(languages)), key=lambda at: (texts[languages[at]], -at)) if languages else 0
    return Filter(languages, table, wrong, most)


def fit(texts: DataFrame, most_texts: int = TRAIN_TEXTS, rows: int = ROWS) -> Filter:
    """Learn all languages of (doc_id, text, lang); rows without a text or language are left out.

    The share of a language's texts that makes about ``most_texts`` is read:
    those whose hashed doc_id is low enough, so nothing is ranked and no text is
    shuffled. The driver gets one count per language and those n-grams that a
    fixed share of a language's sample has, of which there are as many as an
    average text has divided by that share, at most.
    """
    known = texts.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    there = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not there:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0), 0)
    share = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, most_texts / n))])
    place = (F.xxhash64("doc_id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    chosen = known.filter(place < share[F.col("lang")]).select("lang", "text")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                named = batch.column("lang").dictionary_encode()
                code = named.indices.to_numpy().astype(np.int64)
                hashes, doc = grams(batch.column("text"))
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                hashes, lang = hashes[fresh], code[doc[fresh]]
                for at, name in enumerate(named.dictionary.to_pylist()):
                    found, n = np.unique(hashes[lang == at], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    counts = chosen.mapInArrow(seen, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = {name: max(1, min(n, most_texts)) for name, n in there.items()}
    least = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, max(2.0, LEAST_SHARE * v) if v > 20 else 1.0)])
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.filter(F.col("n") >= least[F.col("lang")]).withColumn("rank", F.row_number().over(frequent))
    found = ranked.filter(F.col("rank") <= LANGUAGE_GRAMS).select("lang", "gram").toPandas()
    kept = {name: np.zeros(0, np.uint64) for name in sizes}
    for name, part in found.groupby("lang"):
        kept[name] = part["gram"].to_numpy(np.int64).view(np.uint64)
    return build(kept, there, rows)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1) and counts, the corrected count per language as JSON.

    A null text or one without a letter is ``und`` with score 0. A text with
    letters always gets a learned language: without any known n-gram the one
    with most texts, score 0. Ties go to the name that sorts first. The score is
    the lead of the best count over the next, as a share of the best. With
    nothing learned every answer is ``und``.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", BATCH_BYTES):
                texts = batch.column("text")
                letters = np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\pL"))
                names, scores, every = [], [], []
                found, _ = model.counts(texts) if model.languages else (np.zeros((len(texts), 0)), None)
                for counts, letter in zip(found, letters):
                    every.append(json.dumps(dict(zip(model.languages, counts.round(1).tolist()))))
                    if not letter or not model.languages:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(counts)) if counts.max() > 0 else model.fallback
                    rest = np.delete(counts, best).max(initial=0.0)
                    names.append(model.languages[best])
                    scores.append(float((counts[best] - rest) / counts[best]) if counts[best] > 0 else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(every, pa.string())],
                    ["doc_id", "lang_pred", "score", "counts"],
                )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("counts", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
