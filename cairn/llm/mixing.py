"""Sources mixed to target weights by budgets in a tree.

Levels such as domain, language and source make a tree; its leaves hold
documents. The token budget of a node is dealt to its children by weight.
What a child cannot use, as all its leaves together have too few tokens, goes
to its siblings by weight, and leaves the node only when all of them are full.
A leaf then takes its share as a prefix of a stream of epochs: every epoch is
all its documents in an order seeded anew, whole epochs first, then the first
documents of the next up to the share. How many tokens are mixed is given, or
the least with which no document is lost: leaves below their weight are repeated.

Sums are taken before any shuffle. The order within a leaf is settled by hash
buckets: sums per bucket tell in which bucket the share ends, and only that
bucket's documents are ranked, so a leaf with a third of all rows is no task's
burden. What meets the documents at last is one row per leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import free_name, text_or_empty
from cairn.session import durable

SEED = 17
BUCKET_ROWS = 10_000
LEVELS = ("domain", "lang", "source")


def words(name: str = "text") -> Column:
    """Tokens of a text as the mix counts them: runs of other than ASCII blanks."""
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def order_key(epoch: Column, doc: Column, seed: int = SEED) -> Column:
    """Place of a document in an epoch: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]], node: Column | None = None) -> Column:
    """Whole-number weight of a node, by default in the column of its level, among its siblings; 1 if none is given."""
    node = F.col(level) if node is None else node
    found = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        found = F.when(node == value, F.lit(int(weight))).otherwise(found)
    return found.cast("bigint")


def deal(children: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``budget`` to children (capacity, weight, given: the parent's budget).

    Siblings stand by capacity per weight. Those that their share would fill
    are a prefix of that order; the others split what is left by weight, down
    to single tokens, which go to the first of them. Weight 0 gets nothing.
    """
    ranked = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    rows = children.filter("weight > 0")
    rows = rows.withColumn("_spent", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    rows = rows.withColumn("_share", F.sum("weight").over(after))
    rows = rows.withColumn("_full", F.expr("capacity * _share <= (given - _spent) * weight"))
    rows = rows.withColumn("_left", F.expr("given") - F.sum(F.expr("if(_full, capacity, 0L)")).over(family))
    rows = rows.withColumn("_open", F.sum(F.expr("if(_full, 0L, weight)")).over(family))
    rows = rows.withColumn("budget", F.expr("if(_full, capacity, (_left * weight) div greatest(_open, 1))"))
    rows = rows.withColumn("_over", F.expr("given") - F.sum("budget").over(family))
    opened = F.sum(F.expr("if(_full, 0, 1)")).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one_more = ~F.col("_full") & (opened <= F.col("_over"))
    rows = rows.withColumn("budget", F.col("budget") + F.when(one_more, 1).otherwise(0))
    return rows.drop("_spent", "_share", "_full", "_left", "_open", "_over")


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: int, epochs: int
) -> DataFrame:
    """Budget of every leaf (levels, docs, tokens): adds ``budget``, at most ``epochs`` times its tokens.

    One window per level over the nodes of the tree, never over documents.
    """
    levels = list(levels)
    sized = leaves.withColumn("capacity", F.col("tokens") * epochs)
    given = min(total, sized.agg(F.sum("capacity")).first()[0] or 0)
    nodes = sized.groupBy(levels[0]).agg(F.sum("capacity").alias("capacity"))
    nodes = nodes.withColumn("given", F.lit(given).cast("bigint"))
    dealt = deal(nodes.withColumn("weight", weight_of(levels[0], weights)).withColumn("_root", F.lit(0)), ["_root"], levels[:1])
    for depth in range(1, len(levels)):
        path, above = levels[: depth + 1], levels[:depth]
        parents = dealt.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("budget").alias("given"))
        nodes = sized.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        same = F.lit(True)
        for c in above:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        nodes = nodes.join(parents, same).drop(*[f"_{c}" for c in above])
        dealt = deal(nodes.withColumn("weight", weight_of(levels[depth], weights)), above, path)
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = dealt.select(*[F.col(c).alias(f"_{c}") for c in levels], "budget")
    return leaves.join(named, same, "left").select(*leaves.columns, F.coalesce("budget", F.lit(0)).alias("budget"))


def least_total(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], epochs: int) -> int:
    """Fewest tokens that leave every leaf with weight a whole epoch, while weights hold.

    From the leaves up, a node needs what its children get when each has what
    it needs and all stand by weight, up to ``epochs`` times their tokens. One
    window per level over the nodes of the tree, never over documents.
    """
    levels = list(levels)
    nodes = leaves.withColumn("need", F.col("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    for depth in reversed(range(len(levels))):
        family = Window.partitionBy(*levels[:depth])
        nodes = nodes.withColumn("weight", weight_of(levels[depth], weights)).filter("weight > 0")
        nodes = nodes.withColumn("_most", F.max(F.col("need") / F.col("weight")).over(family))
        nodes = nodes.withColumn("need", F.least(F.ceil(F.col("_most") * F.col("weight")), F.col("capacity")))
        nodes = nodes.groupBy(*levels[:depth]).agg(F.sum("need").alias("need"), F.sum("capacity").alias("capacity"))
    return nodes.first()["need"] or 0


def shares(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], *,
    total: int | None = None, share: float | None = 1.0, epochs: int = 1, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per leaf of documents (doc_id, levels, tokens): where its stream ends.

    Columns: levels, docs, tokens, budget, whole (epochs taken whole), cut_key
    (order key of the last document of the next epoch, null if none), cut_left
    (tokens left for that document), cut_size (tokens it has). ``total`` tokens
    are mixed, or that share of all tokens, or for a share of None the
    ``least_total``. ``docs`` must be a stored table.
    """
    levels = list(levels)
    leaves = durable(docs.groupBy(*levels).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "leaves")
    there, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.max("docs")).first()
    if total is None:
        total = least_total(leaves, levels, weights, epochs) if share is None else int(there * share)
    dealt = budgets(leaves, levels, weights, total, epochs)
    whole = F.expr("if(tokens = 0, 0L, budget div tokens)")
    dealt = dealt.withColumn("whole", whole).withColumn("rest", F.expr("budget - whole * tokens"))
    dealt = durable(dealt, "budgets")
    digits = 2
    while 16**digits * bucket_rows < (most or 0):
        digits += 1
    asked = dealt.filter("rest > 0").select(*[F.col(c).alias(f"_{c}") for c in levels], "whole", "rest")
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    keyed = docs.join(asked, same).withColumn("key", order_key(F.col("whole"), F.col("doc_id"), seed))
    keyed = keyed.withColumn("bucket", F.left("key", F.lit(digits)))
    path = [f"_{c}" for c in levels]
    before = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*path, "bucket", "rest").agg(F.sum("tokens").alias("sum"))
    last = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(before), F.lit(0))).filter(
        "ahead < rest and ahead + sum >= rest"
    ).select(*[F.col(c).alias(f"_{c}") for c in path], F.col("bucket").alias("_bucket"), "ahead")
    same = F.col("bucket") == F.col("_bucket")
    for c in path:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = keyed.join(last, same).groupBy(*path, "key", "rest", "ahead").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*path).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("begin", F.col("ahead") + F.coalesce(F.sum("sum").over(before), F.lit(0)))
    cut = inside.filter("begin < rest and begin + sum >= rest").select(
        *path, F.col("key").alias("cut_key"), (F.col("rest") - F.col("begin")).alias("cut_left"), F.col("sum").alias("cut_size")
    )
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(cut, same, "left").select(*levels, "docs", "tokens", "budget", "whole", "cut_key", "cut_left", "cut_size")


def taken(docs: DataFrame, ends: DataFrame, levels: Sequence[str], tokens: Column | str = "tokens", seed: int = SEED) -> DataFrame:
    """Documents once per epoch that takes them, with ``epoch`` and ``tokens_taken``.

    The last document of a leaf is taken up to its share. Documents without
    tokens are taken in every whole epoch, and in the next one up to its end.
    Rows under one doc_id stand at one place and are cut alike.
    """
    epoch, kept = free_name(docs, "epoch"), free_name(docs, "tokens_taken")
    columns = docs.columns
    # Names of its own, whatever the documents' columns are called.
    own = {c: free_name(docs, f"_leaf_{n}") for n, c in enumerate([*levels, "whole", "cut_key", "cut_left", "key", "times", "epoch"])}
    marked = ends.select(*[F.col(c).alias(own[c]) for c in [*levels, "whole", "cut_key", "cut_left"]])
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(own[c]))
    whole, cut_key, cut_left, at, times, turn = (F.col(own[c]) for c in ("whole", "cut_key", "cut_left", "key", "times", "epoch"))
    key = order_key(whole, F.col("doc_id"), seed)
    rows = docs.join(marked, same).withColumn(own["key"], F.when(cut_key.isNotNull(), key))
    more = F.coalesce(at <= cut_key, F.lit(False))
    rows = rows.withColumn(own["times"], whole + more.cast("bigint")).filter(times > 0)
    rows = rows.withColumn(own["epoch"], F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    size = F.col(tokens) if isinstance(tokens, str) else tokens
    at_cut = (turn == whole) & (at == cut_key)
    return rows.select(
        *columns, turn.alias(epoch), F.when(at_cut, F.least(size, cut_left)).otherwise(size).alias(kept),
    )


#: Fixed values of the queries here: which sources make a domain, by the last digit of their name.
DOMAINS = {"web": "012", "books": "345", "talk": "67"}
OTHER_DOMAIN = "code"


def domain_of(name: str = "source") -> Column:
    """Domain of a source: by its last digit, else ``code``; null for a null source."""
    last = F.right(F.col(name), F.lit(1))
    found = F.lit(OTHER_DOMAIN)
    for domain, digits in DOMAINS.items():
        found = F.when(last.isin(*digits), F.lit(domain)).otherwise(found)
    return F.when(F.col(name).isNotNull(), found)


#: Weights of the queries here.
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "talk": 2, "code": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 3},
}


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, share: float = 1.0, epochs: int = 2, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch and tokens_taken of every document a mix takes.

    Null languages and sources are leaves of their own. A null or empty text has no tokens.
    """
    rows = docs.select("doc_id", domain_of().alias("domain"), "lang", "source", words().alias("tokens"))
    rows = durable(rows, "mix-rows")
    ends = durable(shares(rows, LEVELS, weights, share=share, epochs=epochs, seed=seed), "mix-ends")
    return taken(rows, ends, LEVELS, seed=seed)


def keep_mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, share: float = 0.9, seed: int = SEED) -> DataFrame:
    """The documents that one epoch of the mix takes, whole and with all their columns.

    The last document of a leaf is kept whole. Texts meet one row per leaf;
    whether those rows are broadcast is the planner's choice by their size.
    """
    domain = free_name(docs, "_domain")
    rows = docs.select("doc_id", domain_of().alias("domain"), "lang", "source", words().alias("tokens"))
    rows = durable(rows, "mix-rows")
    ends = durable(shares(rows, LEVELS, weights, share=share, epochs=1, seed=seed), "mix-ends")
    ends = ends.withColumnRenamed("domain", domain)
    found = taken(docs.withColumn(domain, domain_of()), ends, [domain, "lang", "source"], F.lit(0).cast("bigint"), seed)
    return found.select(*docs.columns)


#: Times that the pipeline takes a document at most.
EPOCHS = 4


def with_weight(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> DataFrame:
    """The documents that a mix without loss takes at all: no level of their leaf has weight 0."""
    nodes = {"domain": domain_of(), "lang": F.col("lang"), "source": F.col("source")}
    return docs.filter(F.least(*[weight_of(level, weights, nodes[level]) for level in LEVELS]) > 0)


def repeats(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, text and ``times``: how often a mix that loses no document takes each of them.

    Every document with weight is taken once at least and ``epochs`` times at
    most; in between leaves are repeated until weights hold. Documents are
    taken whole: the last one of a leaf if half of it is within the share.
    """
    docs = with_weight(docs, weights).select("doc_id", "text", domain_of().alias("domain"), "lang", "source")
    rows = durable(docs.select("doc_id", *LEVELS, words().alias("tokens")), "mix-rows")
    ends = durable(shares(rows, LEVELS, weights, share=None, epochs=epochs, seed=seed), "mix-ends")
    marked = ends.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "whole", "cut_key", "cut_left", "cut_size")
    same = F.lit(True)
    for c in LEVELS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    key = F.when(F.col("cut_key").isNotNull(), order_key(F.col("whole"), F.col("doc_id"), seed))
    half = F.expr("2 * cut_left >= cut_size")
    more = F.coalesce((key < F.col("cut_key")) | ((key == F.col("cut_key")) & half), F.lit(False))
    times = F.greatest(F.col("whole") + more.cast("bigint"), F.lit(1).cast("bigint"))
    return docs.join(marked, same).select("doc_id", "text", times.alias("times"))
