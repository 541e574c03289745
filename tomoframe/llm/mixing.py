"""Sources combined to target shares of all tokens by Poisson replication.

Each row has a number between 0 and 1 from a hash of its id and a seed. Its count is the inverse of a Poisson
distribution at that number, whose mean is the repetition rate of its source, and at most max_repeats. Rows are exploded
by their count and shuffled globally by another hash. A rate is at most the source's max_repeats, so that the rows of every
source are drawn, those of the scarcest one too.

The sizes that decide the rates are sums over all rows: per source the tokens in each of BINS equal intervals of the
rows' numbers. From them each source's rate is found by bisection, in a task of its own, so that the tokens of the very rows that
are drawn come closest to its share. Only the total goes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.llm import tokenizers
from tomoframe.session import BROADCAST_BYTES, measured, spread, written

#: Intervals per source.
BINS = 2048
#: Parts of a source where there are too many sources to broadcast.
SALTS = 64


def _counted(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizers.byte_bpe(name, folder)[0].encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "u")), pa.array(sizes, pa.int64())], names=["source", "u", "n_tokens"])

    return run


def poisson_steps(rate: float, most: int) -> tuple[int, np.ndarray]:
    """`first`, and the probabilities of at most first, first + 1, ... up to most - 1: the count of a number u is first and as
    many more as there are steps <= u. Counts that no double between 0 and 1 can have are left out, on both sides."""
    if rate <= 0 or most <= 0:
        return 0, np.empty(0)
    far = 9 * math.sqrt(rate)
    first = min(most, max(0, int(rate - far - 9)))
    k = np.arange(first, min(most, int(rate + far + 40)))
    if not len(k):
        return first, np.empty(0)
    factorials = math.lgamma(first + 1) + np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return first, np.minimum(1.0, np.cumsum(np.exp(k * math.log(rate) - rate - factorials)))


def drawn_tokens(rate: float, most: int, bins: np.ndarray) -> float:
    """Tokens drawn at a rate, from the sums per interval; inside an interval rows count as evenly spread."""
    first, steps = poisson_steps(rate, most)
    above = np.concatenate([[0.0], np.cumsum(bins)])
    return float(first * above[-1] + (above[-1] - np.interp(steps * len(bins), np.arange(len(bins) + 1), above)).sum())


def number_of(seed: int, *more) -> Column:
    """A number from 0 to below 1 by the hash of the row's id, and of more columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), *more), 11) / F.lit(float(2**53))


def _with_source(rows: DataFrame, sources: DataFrame, salt: str) -> DataFrame:
    """`rows` with the columns of their source: broadcast if the sources are small, else joined with each source in parts."""
    if measured(sources) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sources), "source")
    parts = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).join(parts, ["source", "_salt"]).drop("_salt")


def _sized(documents: DataFrame, asked: DataFrame, seed: int, tokenizer: str, folder: str) -> DataFrame:
    """source, u and n_tokens of each row whose source is asked for, written once."""
    rows = documents.select("source", number_of(seed).alias("u"), "text")
    return written(spread(_with_source(rows, asked.select("source"), "u")).mapInArrow(_counted(tokenizer, folder), "source string, u double, n_tokens bigint"), "sizes")


_RATE = "source string, target_share double, max_repeats bigint, n_docs bigint, available_tokens bigint, reach double, rate double, first bigint, steps array<double>"


def _fitted(wanted: float | None, whole: float):
    """The group of a source's sums as one row of _RATE; without a wanted total only what the source can reach."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source, share, most = pdf["source"].iloc[0], float(pdf["share"].iloc[0]), int(pdf["most"].iloc[0])
        bins = np.zeros(BINS)
        there = pdf["bin"].notna()
        np.add.at(bins, pdf["bin"][there].astype(int), pdf["t"][there])
        reach, rate = drawn_tokens(most, most, bins), 0.0
        if wanted is not None and bins.sum() > 0:
            own = wanted * share / whole
            low, rate = 0.0, float(most)
            for _ in range(60 if own < reach * (1 - 1e-12) else 0):
                mid = (low + rate) / 2
                low, rate = (mid, rate) if drawn_tokens(mid, most, bins) < own else (low, mid)
        first, steps = poisson_steps(rate, most)
        return pd.DataFrame([(source, share, most, int(pdf["n"].fillna(0).sum()), int(bins.sum()), reach, rate, first, steps.tolist())], columns=[c.split()[0] for c in _RATE.split(", ")])

    return run


def rates(documents: DataFrame, targets: DataFrame, seed: int, total_tokens: float | None, tokenizer: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """One row of _RATE per source of `targets`, and the sizes of the rows of these sources. See `mixed`."""
    asked = targets.groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("bigint").alias("most")).where("source is not null and share > 0 and most > 0")
    sized = _sized(documents, asked, seed, tokenizer, folder)
    sums = sized.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    sums = written(asked.join(sums, "source", "left"), "sums")
    by_source = lambda wanted, whole: sums.groupBy("source").applyInPandas(_fitted(wanted, whole), _RATE)
    # The largest total at which no source has to go beyond its max_repeats.
    there = by_source(None, 1.0).where("available_tokens > 0").agg(F.sum("target_share").alias("whole"), F.min(F.col("reach") / F.col("target_share")).alias("scarcest")).first()
    most = there["scarcest"] * there["whole"] if there["whole"] else 0.0
    total = most if total_tokens is None else min(float(total_tokens), most)
    return written(by_source(total, there["whole"] or 1.0), "rates"), sized


def _copies(rows: DataFrame, found: DataFrame, salt: str, u: Column) -> DataFrame:
    """`rows` with their `count`, which is above 0."""
    steps = found.where("available_tokens > 0").select("source", "first", "steps")
    drawn = _with_source(rows, steps, salt).withColumn("count", F.col("first") + F.size(F.filter("steps", lambda s: s <= u)))
    return drawn.drop("first", "steps").where("count > 0")


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: float | None = None, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.FOLDER) -> DataFrame:
    """The combined corpus, globally shuffled: source, doc_id, copy (from 1), text.

    documents: doc_id BIGINT, source, text; targets: source, target_share, max_repeats. Sources that only one of them has
    give no rows; the shares of the others are taken as parts of their sum. `total_tokens` is the size to reach; by
    default, and at most, the largest at which every share can be reached with rates up to max_repeats. Null and empty texts
    have no tokens and are drawn like others. Rows with equal doc_id are drawn alike. A null source is in no target.
    """
    found, _ = rates(documents, targets, seed, total_tokens, tokenizer, folder)
    copies = _copies(documents.select("doc_id", "source", "text"), found, "doc_id", number_of(seed))
    each = copies.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"), "text")
    return each.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).repartition("place").sortWithinPartitions("place").drop("place")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: float | None = None, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.FOLDER) -> DataFrame:
    """Per source of `targets`: target_share, max_repeats, n_docs, available_tokens, rate, n_copies, most_copies (of one
    document), mixed_tokens and actual_share of `mixed`, counted over the rows that are drawn."""
    found, sized = rates(documents, targets, seed, total_tokens, tokenizer, folder)
    drawn = _copies(sized, found, "u", F.col("u"))
    reached = written(drawn.groupBy("source").agg(F.sum("count").alias("n_copies"), F.max("count").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("count")).alias("mixed_tokens")), "reached")
    total = reached.agg(F.sum("mixed_tokens")).scalar()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_copies", "most_copies", "mixed_tokens")]
    return (
        found.join(reached, "source", "left")
        .select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "rate", *numbers)
        .withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", total), F.lit(0.0)))
    )
