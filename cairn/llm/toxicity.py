"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: tokens of labelled texts (words, their beginnings and endings) are
counted per label, each word once a text so that a long or repetitive text
has no more say than others; an informative Dirichlet prior drawn from all counts turns them into log-odds with a variance,
and tokens far enough from zero keep their log-odds. Every other token shares
the log-odds of "some other token", a slight negative drift. Scoring: one
linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa,
1999). Their scores are judged by an extreme-value law whose two constants are
fitted to clean texts, and the surprise of all significant segments, minus the
log of their expected number by chance, adds up to the evidence of the text. A
logistic curve turns evidence into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches
from cairn.session import durable

#: At most so many labelled texts are learned from, those of lowest hashed doc_id.
TRAIN_ROWS = 20_000
#: Weight of the prior as a share of all counts; least |z| of a token that counts; tokens kept.
PRIOR, LEAST_Z, TERMS = 0.05, 5.0, 20_000
#: Lengths of the word beginnings and endings that are tokens beside the word.
PARTS = range(3, 8)
EXPECTED = 0.05
#: Words a worker remembers the score of.
CACHE_WORDS = 50_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def token(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return word.lower().strip(EDGE)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) with their scores, in linear time.

    Each candidate keeps the sums before and after it. A new positive score
    looks left for the nearest candidate that began lower; a pointer past those
    that cannot be it keeps the whole scan linear.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, left sum, right sum, nearest lower
    for at in np.flatnonzero(scores > 0).tolist():
        begin, left, right = at, float(sums[at]), float(sums[at + 1])
        near = len(found) - 1
        while True:
            while near >= 0 and found[near][2] >= left:
                near = found[near][4]
            if near < 0 or found[near][3] >= right:
                break
            begin, left = found[near][0], found[near][2]
            del found[near:]
            near = len(found) - 1
        found.append((begin, at + 1, left, right, near))
    return [(b, e, r - l) for b, e, l, r, _ in found]


def tokens(word: str) -> list[str]:
    """A word and its beginnings (``be^``) and endings (``$ng``); shorter ones than the word only."""
    sizes = [k for k in PARTS if k < len(word)]
    return [word, *(word[:k] + "^" for k in sizes), *("$" + word[-k:] for k in sizes)]


@dataclass
class Model:
    """Token log-odds, drift of other tokens, extreme-value constants and the final curve."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = -0.01
    decay: float = 1.0
    rate: float = 1.0
    slope: float = 0.0
    base: float = -2.0

    def token_scores(self, words: list[str], cache: dict[str, float]) -> np.ndarray:
        """Scores of the words; ``cache`` remembers words as written."""
        scores = []
        for word in words:
            score = cache.get(word)
            if score is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                known = [self.weights[x] for x in tokens(token(word)) if x in self.weights]
                score = cache[word] = max(known, key=abs, default=self.drift)
            scores.append(score)
        return np.array(scores, np.float64)

    def expected(self, score: float, length: int) -> float:
        """Segments so high that chance alone puts in a clean text of this length."""
        return self.rate * max(length, 1) * math.exp(-self.decay * score)

    def passages(self, words: list[str], cache: dict[str, float]) -> list[tuple[int, int, float, float]]:
        """Significant segments: begin, end (in words), score, expected number by chance."""
        every = [(*s, self.expected(s[2], len(words))) for s in segments(self.token_scores(words, cache))]
        return [s for s in every if s[3] <= EXPECTED]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        return 1.0 / (1.0 + np.exp(-(self.base + self.slope * np.log1p(evidence))))


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    """Summed surprise, in nats, of the significant segments."""
    return sum(-math.log(max(s[3], 1e-300)) for s in found)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), by lowest hashed doc_id.

    ``labels`` is (doc_id, ``label``); rows without either are left out, of
    several labels of one doc_id the highest counts. The chosen labels (12
    bytes each, ``rows`` at most) are broadcast to the scan of texts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = durable(chosen.withColumnRenamed("doc_id", "_id"), "chosen-labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"
    )


def token_counts(texts: DataFrame) -> DataFrame:
    """token, toxic and clean: texts of each label with a word of that token, summed over words.

    Words are counted per task first, and spread into their parts only once all
    tasks' counts of a word have met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole, "text")):
            both = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                both[label].update(set(map(token, set(text.split()))))
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([both[k][n] for n in names], pa.int64()) for k in (1, 0)],
                ["token", "toxic", "clean"],
            )

    def summed(counted: DataFrame) -> DataFrame:
        return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    words = summed(texts.select("text", "label").mapInArrow(count, "token string, toxic bigint, clean bigint"))
    parts = [F.col("token")]
    for k in PARTS:
        longer = F.length("token") > k
        parts.append(F.when(longer, F.concat(F.left("token", F.lit(k)), F.lit("^"))))
        parts.append(F.when(longer, F.concat(F.lit("$"), F.right("token", F.lit(k)))))
    spread = words.filter("token <> ''").select(F.explode(F.array_compact(F.array(*parts))).alias("token"), "toxic", "clean")
    return summed(spread)


def log_odds(counts: DataFrame, toxic: int, clean: int, prior: float = PRIOR) -> DataFrame:
    """token, toxic, clean, odds (log-odds under the prior), z (odds over their deviation)."""
    weight = prior * (toxic + clean)
    share = prior * (F.col("toxic") + F.col("clean"))
    one, two = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(one / (F.lit(toxic + weight) - one)) - F.log(two / (F.lit(clean + weight) - two))
    return counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / one + 1 / two))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, slightly held back, by Newton's steps."""
    design, at = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (y - p) - ridge @ at
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, slope)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def _extreme(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """Decay and rate of the law P(best <= x) = exp(-rate * length * exp(-decay * x)), most likely ones."""
    seen = best > 0
    if seen.sum() < 10:
        return 1.0, 1e-3
    spread = float(np.std(best[seen])) or 1.0
    chosen, found = -np.inf, (1.0, 1e-3)
    for decay in np.geomspace(0.05, 20.0, 120) / spread:
        mass = np.sum(length * np.exp(-decay * best))
        rate = seen.sum() / mass
        # Texts without any positive score are known only to have stayed at zero.
        value = np.sum(np.log(rate * decay * length[seen]) - decay * best[seen]) - rate * mass
        if value > chosen:
            chosen, found = value, (float(decay), float(rate))
    return found


def fit(texts: DataFrame, prior: float = PRIOR, least_z: float = LEAST_Z, terms: int = TERMS) -> Model:
    """Learn from (doc_id, text, label 0 or 1), a bounded sample such as ``labelled`` gives.

    To the driver come the kept terms and three numbers per sampled text. No
    rows, or rows of one label only, give a model that scores the base rate.
    """
    texts = durable(texts, "labelled")
    ones, rows = texts.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(base=math.log((ones + 0.5) / (rows - ones + 0.5)))
    if ones == 0 or ones == rows:
        return model
    counts = durable(token_counts(texts), "token-counts")
    whole = counts.filter(~F.col("token").contains("^") & ~F.col("token").contains("$"))
    toxic, clean = whole.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not toxic or not clean:
        return model
    scored = log_odds(counts, toxic, clean, prior).filter(F.abs("z") >= least_z)
    kept = scored.orderBy(F.abs("z").desc(), "token").limit(terms).collect()
    model.weights = {r["token"]: r["odds"] for r in kept}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                words = text.split()
                found = segments(model.token_scores(words, cache))
                out.append((label, len(words), [s[2] for s in found]))
            yield pd.DataFrame(out, columns=["label", "length", "scores"])

    seen = texts.select("text", "label").mapInPandas(best, "label int, length bigint, scores array<double>")
    top = seen.withColumn("best", F.coalesce(F.array_max("scores"), F.lit(0.0)))
    top = durable(top, "segments")
    clean_rows = top.filter("label = 0").select("length", "best").toPandas()
    model.decay, model.rate = _extreme(
        clean_rows["best"].to_numpy(), np.maximum(clean_rows["length"].to_numpy(float), 1.0)
    )
    surprise = -F.log(F.lit(model.rate) * F.greatest("length", F.lit(1)))
    gained = F.aggregate(
        F.transform("scores", lambda s: surprise + F.lit(model.decay) * s), F.lit(0.0),
        lambda a, s: a + F.when(s >= -math.log(EXPECTED), s).otherwise(0.0),
    )
    points = top.select("label", gained.alias("evidence")).toPandas()
    model.base, model.slope = _curve(np.log1p(points["evidence"].to_numpy()), points["label"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1), passages (begin and end in words, score, expected by chance).

    Null, empty and wordless texts have no passages and the score of no evidence.
    """
    kind = docs.schema["doc_id"].dataType
    passage = T.StructType([T.StructField(n, t) for n, t in (
        ("begin", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()), ("expected", T.DoubleType()))])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()),
                           T.StructField("passages", T.ArrayType(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        names = [f.name for f in passage]
        kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                                    ("expected", pa.float64())]))
        for whole in batches:
            for batch in small_batches(whole, "text"):
                found = [model.passages((t or "").split(), cache) for t in batch.column("text").to_pylist()]
                scores = model.probability(np.array([evidence(f) for f in found]))
                spans = [[dict(zip(names, s)) for s in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kinds)],
                    ["doc_id", "score", "passages"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents that score under ``threshold``, as they were. A null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for whole in batches:
            for batch in small_batches(whole, "text"):
                found = [evidence(model.passages((t or "").split(), cache)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(model.probability(np.array(found, float)) < threshold))

    return docs.mapInArrow(run, docs.schema)
