"""Spelling variants: words one letter apart, found by search schemes over FM-indexes.

1. Words are counted per task before the shuffle; those long and frequent
   enough are the vocabulary.
2. Two words that are one inserted, deleted or replaced letter apart agree
   exactly on one half of the first: its beginning or its end. So a word asks
   only words that carry the same half, and the vocabulary is dealt into shards
   by half. A half that very many words share is cut into blocks, and all its
   blocks of questions meet all its blocks of words.
3. Each shard builds an FM-index of its delimited words, of their letters for
   the one half and of the reversed letters for the other: the two directions of
   a bidirectional index. A question matches a half exactly by backward steps
   from the delimiter, then extends over the other half allowing one error, all
   as intervals of suffix ranks, many questions at a time.
4. A word's form is its most frequent near word, if that is frequent enough;
   roots are found by following forms, with steps that double.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches
from cairn.llm.line_dedup import LOWER
from cairn.session import durable

#: Fixed values of op11: least code points and occurrences of a word, how many times more frequent its form is,
#: and one run in so many that loses a letter.
MIN_CHARS, MIN_COUNT, TIMES, DAMAGED = 6, 5, 5, 199
#: Words of an index, and questions to it, that one task holds; questions searched at a time.
SHARD_WORDS, AT_ONCE = 20_000, 2_000
#: Words a task counts before it passes them on.
HELD_WORDS = 200_000
END = "\0"


def damaged(run: str, start: int, every: int) -> str:
    """A run without one letter if its checksum, continued from ``start``, says so."""
    h = zlib.crc32(run.encode(), start)
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def counted_words(docs: DataFrame, min_chars: int = MIN_CHARS, every: int = DAMAGED) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points and how often they stand in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower
    case. One run in ``every`` (0: none) loses a letter, chosen by the CRC-32 of
    ``<doc_id>:<run>``; a null doc_id is the empty text there. A null text has
    no words. Shorter runs are never looked at, as they do not get longer.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for whole in batches:
            for batch in small_batches(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if not text:
                        continue
                    found = Counter(runs.findall(text.encode().translate(LOWER).decode()))
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in found.items():
                        word = damaged(run, start, every)
                        if len(word) >= min_chars:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of distinct words, each between delimiters, over rotations of one circular text."""

    def __init__(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer((END + END.join(words)).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)  # the delimiter is the lowest
        self.size = len(codes)
        begins = np.cumsum(sizes + 1) - sizes - 1
        self.word_at = np.full(self.size, -1, np.int64)
        self.word_at[begins] = np.arange(len(words))
        rank, step = codes.astype(np.int64), 1
        while True:
            pair = rank * (self.size + 1) + np.roll(rank, -step)
            distinct, rank = np.unique(pair, return_inverse=True)
            if len(distinct) == self.size:
                break
            step *= 2
        self.suffixes = np.empty(self.size, np.int64)
        self.suffixes[rank] = np.arange(self.size)
        before = codes[self.suffixes - 1].astype(np.int64)
        self.steps = np.sort(before * self.size + np.arange(self.size))

    def codes(self, text: np.ndarray) -> np.ndarray:
        """Codes of letters; a letter the index lacks has a code past all others."""
        spot = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        return np.where(self.letters[spot] == text, spot, len(self.letters)).astype(np.int64)

    def extend(self, letter: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffix ranks once ``letter`` is put before what they stand for."""
        own = np.asarray(letter) * self.size
        return np.searchsorted(self.steps, own + low), np.searchsorted(self.steps, own + high)

    def near(self, questions: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, word) with exactly one error before the last ``halves`` letters of the question, each once."""
        flat = self.codes(np.frombuffer("".join(questions).encode("utf-32-le"), np.uint32))
        sizes = np.fromiter(map(len, questions), np.int64, len(questions))
        start = np.cumsum(sizes) - sizes
        ask = np.arange(len(questions))
        low, high = self.extend(0, np.zeros(len(ask), np.int64), np.full(len(ask), self.size))
        for t in range(int(halves.max(initial=0))):
            now = np.flatnonzero((halves > t) & (low < high))
            if not now.size:
                break
            low[now], high[now] = self.extend(flat[start[now] + sizes[now] - 1 - t], low[now], high[now])
        left = sizes - halves
        alive = low < high
        ask, low, high, left = ask[alive], low[alive], high[alive], left[alive]
        wrong = []
        some = np.arange(1, len(self.letters))
        while ask.size:
            # One error here: any letter too many (nothing consumed) or in place of the next one, or none for it.
            lo, hi = self.extend(some[None, :], low[:, None], high[:, None])
            row, col = np.nonzero(lo < hi)
            wrong.append((ask[row], left[row], lo[row, col], hi[row, col]))
            more = left > 0
            own = np.where(more, flat[np.maximum(start[ask] + left - 1, 0)], -1)
            other = more[row] & (some[col] != own[row])
            wrong.append((ask[row][other], left[row][other] - 1, lo[row, col][other], hi[row, col][other]))
            wrong.append((ask[more], left[more] - 1, low[more], high[more]))
            ask, low, high, left, own = ask[more], low[more], high[more], left[more] - 1, own[more]
            low, high = self.extend(own, low, high)
            alive = low < high
            ask, low, high, left = ask[alive], low[alive], high[alive], left[alive]
        if not wrong:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ask, left, low, high = (np.concatenate(part) for part in zip(*wrong))
        found = []
        while ask.size:
            done = left == 0
            lo, hi = self.extend(0, low[done], high[done])
            hit = lo < hi
            found.append(np.stack([ask[done][hit], self.word_at[self.suffixes[lo[hit]]]], 1))
            ask, left, low, high = ask[~done], left[~done] - 1, low[~done], high[~done]
            low, high = self.extend(flat[start[ask] + left], low, high)
            alive = low < high
            ask, left, low, high = ask[alive], left[alive], low[alive], high[alive]
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


def _halves(size: Column, way: int) -> Column:
    """Letters of a word that must agree exactly: its longer last half, or its shorter first one."""
    return (F.ceil(size / 2) if way == 0 else F.floor(size / 2)).cast("int")


def _carried(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words by the halves they carry (index side) and by the half they ask for: (way, half, word[, size])."""
    index, asks = [], []
    for way in (0, 1):
        size = F.length("word")
        cut = (lambda k: F.right("word", k)) if way == 0 else (lambda k: F.left("word", k))
        sizes = F.array_distinct(F.array(*[_halves(size + d, way) for d in (-1, 0, 1)]))
        index.append(words.select(F.lit(way).alias("way"), F.explode(sizes).alias("size"), "word").select(
            "way", F.concat_ws(":", "size", cut(F.col("size"))).alias("half"), "word"))
        asks.append(words.select(F.lit(way).alias("way"), _halves(size, way).alias("size"), "word").select(
            "way", F.concat_ws(":", "size", cut(F.col("size"))).alias("half"), "word", "size"))
    return index[0].unionByName(index[1]), asks[0].unionByName(asks[1])


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near): all ordered pairs of distinct words (column ``word``, a stored table) that are one letter apart."""
    index, asks = _carried(words)
    groups = index.groupBy("way", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = durable(groups.withColumn("blocks", F.expr(f"int(ceil(n / {shard_words}))")), "halves")
    shards = -(-(groups.agg(F.sum("n")).first()[0] or 0) // shard_words)
    shard = F.pmod(F.xxhash64("half", "part", "ask"), F.lit(max(1, shards)))
    # Block ``part`` of the words of a half meets block ``ask`` of its questions.
    own, every = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    index = index.join(groups, ["way", "half"]).withColumn("part", own).withColumn("ask", every)
    asks = asks.join(groups, ["way", "half"]).withColumn("ask", own).withColumn("part", every)
    index = index.select("way", shard.alias("shard"), "word").distinct()
    asks = asks.select(F.col("way").alias("asked_way"), shard.alias("asked_shard"), F.col("word").alias("question"), "size")

    def search(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pairs = [pd.DataFrame({"word": [], "near": []}, dtype=object)]
        if len(known) and len(asked):
            turn = 1 if asked["asked_way"].iloc[0] == 0 else -1
            there = known["word"].to_numpy()
            built = Index([w[::turn] for w in there])
            for at in range(0, len(asked), AT_ONCE):
                part = asked["question"].to_numpy()[at:at + AT_ONCE]
                q, w = built.near([x[::turn] for x in part], asked["size"].to_numpy(np.int64)[at:at + AT_ONCE])
                pairs.append(pd.DataFrame({"word": part[q], "near": there[w]}))
        return pd.concat(pairs, ignore_index=True)

    found = index.groupBy("way", "shard").cogroup(asks.groupBy("asked_way", "asked_shard")).applyInPandas(search, "word string, near string")
    return found.distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to; the word itself without one.

    Forms are ever more frequent, so no chain comes back. Steps double each round.
    """
    rows = durable(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(rows.filter("root <> word").join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return rows
        rows = durable(rows.filter("root = word").unionByName(moved.select("word", "root")), "roots")


def variants(
    docs: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES, min_chars: int = MIN_CHARS,
    every: int = DAMAGED, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary; see ``counted_words`` for nulls.

    Near words differ by one inserted, deleted or replaced code point. The form
    is the near word of largest n, of equal ones the first in code-point order,
    if its n is at least ``times`` the word's. No texts, no rows; columns other
    than doc_id and text are not read; rows under one doc_id all count.
    """
    words = durable(counted_words(docs, min_chars, every).filter(F.col("n") >= min_count), "vocabulary")
    pairs = near_pairs(words, shard_words).join(words.toDF("near", "near_n"), "near")
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    fit = -F.col("best.less") >= times * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fit, F.col("best.near")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n"),
    )
    rows = durable(rows, "forms")
    return rows.join(roots_of(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")
