"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

Statistics of every text are plain Columns. Their ratios go into relative-error
quantile sketches (Masson, Rim and Lee, 2019): counts in buckets that grow by a
fixed factor, so a quantile is within one percent and sketches merge by adding
counts. Each group of language and source gets fences from its own sketch; a
group of few documents takes the merged sketch of its language, or of all.
Where the upper quartile is zero, a high quantile of the sketch is the fence. No
fixed cutoff takes part unless the caller gives floors.
The fences are joined to the statistics, and documents outside go.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import free_name, text_or_empty
from cairn.llm.fingerprints import words_of
from cairn.session import durable

WINDOW = 8
ACCURACY = 0.01
GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
LEAST_VALUE = 1e-6
#: Fences stand so many quartile distances outside the quartiles; groups under LEAST_DOCS take a wider sketch.
REACH, LEAST_DOCS = 3.0, 200
#: Quantile that is the fence of a ratio whose upper quartile is zero.
HIGH = 0.99
#: From the value of a bucket to its upper edge: no document is lost to the rounding of the sketch.
SLACK = (GROWTH + 1) / 2 * (1 + 1e-6)
#: Ratios that are judged, with the floors of op5, which its check SQL fixes: least upper fences.
RATIOS = {"symbol_ratio": 0.1, "dup_line_ratio": 0.3, "repeat_ratio": 0.3, "word_length": 8.0}


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add how many words stand in windows of eight that occur twice or more in the list.

    Hashes of all windows are made once. Only a list with a repeated window is
    looked at further: its windows are sorted by hash and place, those equal to
    a neighbour are repeated, and the words they cover are counted along their
    sorted places. All steps are linear or a sort.
    """
    hashes, places = free_name(df, "_windows"), free_name(df, "_places")
    each = F.col(words)
    n = F.size(each)
    window = lambda w, i: F.xxhash64(w, *[F.get(each, i + k) for k in range(1, WINDOW)])
    made = F.when(n >= WINDOW, F.transform(F.slice(each, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))), window))
    rows = df.withColumn(hashes, F.coalesce(made, F.array().cast("array<bigint>")))
    several = F.size(F.array_distinct(hashes)) < F.size(hashes)
    rows = rows.withColumn(places, F.when(several, F.sort_array(F.transform(
        hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col(places)
    equal = lambda x, i: (
        ((i > 0) & (F.get(at, i - 1)["h"] == x["h"])) | F.coalesce(F.get(at, i + 1)["h"] == x["h"], F.lit(False))
    )
    rows = rows.withColumn(places, F.sort_array(F.transform(F.filter(at, equal), lambda x: x["i"])))
    step = lambda p, i: F.least(F.coalesce(F.get(F.col(places), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    covered = F.aggregate(F.transform(places, step), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.withColumn(name, F.coalesce(covered, F.lit(0).cast("bigint"))).drop(hashes, places)


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source and the counts of its text; a null text counts as empty."""
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    return repeated_words(rows, "words", "n_repeat_words").drop("words")


def ratio(top: str, bottom: str) -> Column:
    """A quotient, zero where there is nothing to divide by."""
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def with_ratios(stats: DataFrame) -> DataFrame:
    """Add the ratios the rules judge."""
    return stats.withColumns({
        "symbol_ratio": ratio("n_symbols", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words"),
    })


def bucket(value: Column) -> Column:
    """Bucket of a value in a sketch; values next to zero share the lowest."""
    place = F.ceil(F.round(F.log(F.greatest(value, F.lit(LEAST_VALUE))) / F.lit(math.log(GROWTH)), 6))
    return F.when(value < LEAST_VALUE, F.lit(-1_000_000)).otherwise(place).cast("int")


def bucket_value(place: Column) -> Column:
    """The value a bucket stands for, within one percent of all in it."""
    return F.when(place == -1_000_000, F.lit(0.0)).otherwise(F.lit(2 / (GROWTH + 1)) * F.pow(F.lit(GROWTH), place))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketch of each group, counted per task before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), bucket(F.col(name)).alias("bucket")) for name in RATIOS]))
    return rows.select("lang", "source", each.alias("x")).groupBy(
        "lang", "source", F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def quartiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles q1 and q3, a high quantile and the count per key and rule, from sketches merged to these keys."""
    merged = parts.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    # A sketch is at most some two thousand buckets, whatever it has counted.
    whole = merged.groupBy(*keys, "rule").agg(
        F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sketch")
    )

    def at(q: float) -> Column:
        wanted = F.lit(q) * F.col("docs")
        begin = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("at"))
        step = lambda a, e: F.struct(
            (a["upto"] + e["n"]).alias("upto"),
            F.coalesce(a["at"], F.when(a["upto"] + e["n"] >= wanted, e["bucket"])).alias("at"),
        )
        return bucket_value(F.aggregate("sketch", begin, step, lambda a: a["at"]))

    return whole.select(*keys, "rule", "docs", at(0.25).alias("q1"), at(0.75).alias("q3"), at(HIGH).alias("high"))


def fences(parts: DataFrame, least_docs: int = LEAST_DOCS, floors: Mapping[str, float] | None = None) -> DataFrame:
    """One row per language and source: an upper fence for each rule and a lower one for word_length.

    With ``floors`` no upper fence is lower than its floor, and the plain
    quartile fences stand beside them, without the high quantile and slack.
    """
    values = ("q1", "q3", "high")
    own = quartiles(parts, ["lang", "source"])
    wide = quartiles(parts, ["lang"]).toDF("_lang", "_rule", "_docs", *[f"_{q}" for q in values])
    every = quartiles(parts, []).toDF("_all_rule", "_all_docs", *[f"_all_{q}" for q in values])
    rows = own.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
    rows = rows.join(every, F.col("rule") == F.col("_all_rule"))
    pick = lambda q: F.when(F.col("docs") >= least_docs, F.col(q)).when(
        F.col("_docs") >= least_docs, F.col(f"_{q}")).otherwise(F.col(f"_all_{q}"))
    rows = rows.select("lang", "source", "rule", *[pick(q).alias(q) for q in values])
    reach = REACH * (F.col("q3") - F.col("q1"))
    above, below = F.col("q3") + reach, F.col("q1") - reach
    if floors is None:
        above = F.when(F.col("q3") > 0, above).otherwise(F.col("high")) * SLACK
        below = below / SLACK
    held = lambda rule: above if floors is None else F.greatest(above, F.lit(floors[rule]))
    upper = lambda rule: F.max(F.when(F.col("rule") == rule, held(rule)))
    lower = F.max(F.when(F.col("rule") == "word_length", below))
    return rows.groupBy("lang", "source").agg(
        *[upper(rule).alias(f"most_{rule}") for rule in RATIOS], lower.alias("least_word_length")
    )


def judged(docs: DataFrame, least_docs: int = LEAST_DOCS, floors: Mapping[str, float] | None = None) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept.

    A null language or source is a group of its own. A text without words fails
    the base rules. Documents outside any fence of their group are not kept.
    """
    stats = durable(with_ratios(statistics(docs)), "statistics")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = durable(fences(sketches(stats), least_docs, floors), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.col("word_length") >= F.col("least_word_length")
    for rule in RATIOS:
        inside = inside & (F.col(rule) <= F.col(f"most_{rule}"))
    return stats.join(limits, same).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & inside).alias("kept"),
    )


def keep_good(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents the rules keep, with all columns; of rows under one doc_id all must be kept."""
    doc = free_name(docs, "_doc")
    out = judged(docs, least_docs).groupBy("doc_id").agg(F.min("kept").alias("kept")).filter(~F.col("kept"))
    lost = out.select(F.col("doc_id").alias(doc))
    return docs.join(lost, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")
