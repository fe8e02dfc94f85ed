"""Mixing sources to target weights by distributed prefix sums of token counts.

Documents are counted in tokens of a public tokenizer. Each gets a hash-random key; ranges of the
key are numbered buckets, so within a source the order by key is a range sort. Bucket sums are
prefix-summed per source (few rows), the rest only within each bucket; no task ever holds a source.
The budget of a source is its share of the wanted size, at most ``max_repeats`` times its tokens:
whole epochs first, then the documents up to the exact cut in key order.

Budgets that a source cannot fill are left unfilled by default, which keeps the other sources at
their shares of the wanted size; ``refill`` hands them to the others in proportion.

Documents without text count zero tokens and come with every epoch; documents whose source is null
or not in the mix are not drawn; sources without documents are reported with nothing. Weights are
scaled to the sum of their mix; null or negative weights and repeats count as zero; several rows of
one source in a mix add up their weights, the largest ``max_repeats`` holds.
"""

from __future__ import annotations

import base64

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import broadcast_if_small, cut_lineage, ship

#: Where the vocabulary is unless ``spark.lodestrata.tokenizer`` says otherwise; read on the driver only.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most target rows that may be broadcast.
TARGETS = 10_000


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, tokens: whole texts, counted by Arrow batches; the vocabulary is broadcast."""
    tokenizer = tokenizer or documents.sparkSession.conf.get("spark.lodestrata.tokenizer", TOKENIZER)
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0)

    counted = F.pandas_udf(_iterator(count), T.LongType())
    return documents.select("doc_id", "source", counted("text").alias("tokens"))


def _iterator(count):
    from collections.abc import Iterator

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return count(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def placed(counts: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Each document's tokens before it (``before``) in the key order of its source."""
    keyed = counts.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("bucket", F.floor((F.col("key").cast("double") / 2.0**63 + 1) / 2 * buckets))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return inner.join(sums, ["source", "bucket"]).select(
        "doc_id", "source", "tokens", (F.col("offset") + F.col("inner")).alias("before")
    )


def budgets(counts: DataFrame, targets: DataFrame, refill: bool = False) -> DataFrame:
    """mix_name, source, target_share, wanted (mix size in tokens), available, cap, budget; one row per target source."""
    clean = targets.where(F.col("source").isNotNull()).groupBy("mix_name", "source").agg(
        F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"),
        F.max(F.greatest(F.coalesce("size_ratio", F.lit(0.0)), F.lit(0.0))).alias("ratio"),
    )
    held = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    corpus = counts.agg(F.sum("tokens")).first()[0] or 0
    mix = Window.partitionBy("mix_name")
    weights = F.sum("weight").over(mix)
    t = clean.join(held, "source", "left")
    t = t.select(
        "mix_name", "source", F.when(weights > 0, F.col("weight") / weights).otherwise(0.0).alias("target_share"),
        (F.max("ratio").over(mix) * corpus).alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"), "repeats",
    ).withColumn("cap", F.col("available") * F.col("repeats"))
    t = t.withColumn("budget", F.least(F.col("target_share") * F.col("wanted"), F.col("cap").cast("double")))
    if refill:
        # Sources fill up in order of cap by share: each one that reaches its cap leaves the rest of the
        # size to those after it, which share it by weight. One sorted pass finds where that ends.
        share, cap = F.col("target_share"), F.col("cap").cast("double")
        order = Window.partitionBy("mix_name").orderBy(F.when(share > 0, cap / share).asc_nulls_last(), "source")
        before = F.coalesce(F.sum(F.when(share > 0, cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum(share).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        t = t.withColumn("full", (share > 0) & (cap * rest <= (F.col("wanted") - before) * share))
        taken, open_ = F.sum(F.when(F.col("full"), cap)).over(mix), F.sum(F.when(~F.col("full"), share)).over(mix)
        level = (F.col("wanted") - F.coalesce(taken, F.lit(0.0))) / open_
        t = t.withColumn("budget", F.when(F.col("full"), cap).when(share > 0, F.least(cap, level * share)).otherwise(0.0)).drop("full")
    return t


def draw(documents: DataFrame, targets: DataFrame, seed: int = 17, tokenizer: str | None = None, buckets: int = 4096, refill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mix_name, source, doc_id, tokens, copies) and the budget of each mix and source.

    The document at the cut is taken if more than half of it is within the budget, so a source
    misses its budget by at most half of one document.
    """
    counts = cut_lineage(token_counts(documents, tokenizer))
    plan = budgets(counts, targets, refill)
    small = broadcast_if_small(plan, targets.count(), TARGETS)
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("available")
    extra = F.when(F.col("before") + F.col("tokens") / 2 < rest, 1).otherwise(0)
    copies = F.least(epochs + extra, F.col("repeats")).cast("int")
    drawn = placed(counts.where(F.col("source").isNotNull()), seed, buckets).join(small, "source")
    return drawn.withColumn("copies", copies).where("copies > 0").select("mix_name", "source", "doc_id", "tokens", "copies"), plan


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Actual shares: mix_name, source, target_share, wanted_tokens, budget_tokens, n_docs, n_copies, actual_tokens, actual_share, most_repeats."""
    drawn, plan = draw(documents, targets, **options)
    got = drawn.groupBy("mix_name", "source").agg(
        F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"),
        F.max("copies").alias("most_repeats"),
    )
    both = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["n_docs", "n_copies", "actual_tokens", "most_repeats"])
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    return both.select(
        "mix_name", "source", "target_share", F.col("wanted").alias("wanted_tokens"), F.col("budget").alias("budget_tokens"),
        "n_docs", "n_copies", "actual_tokens", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0).alias("actual_share"), "most_repeats",
    )


ship(__name__)
