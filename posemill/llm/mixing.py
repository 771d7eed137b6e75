"""Mixtures of sources at target shares of tokens, with capped repetition."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.runtime import Scratch, ship

ship(__name__)

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Pre-token pattern of the public byte-level vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNITS = 1 << 40
"""Bernoulli draws compare 40 hash bits with the fraction."""


@lru_cache(maxsize=4)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in f.read().splitlines() if x)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, text: str, into: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents with a column of token counts; 0 for null and empty texts. Whole texts are tokenized."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer).encode_ordinary
        for t in texts:
            yield t.map(lambda x: len(encode(x)) if x else 0).astype("int64")

    return documents.withColumn(into, count(text))


def mixing_rates(sizes: DataFrame, targets: DataFrame, source: str, size: str, share: str, cap: str, total: float | None = None) -> DataFrame:
    """Repetition rate per source: source, size, share, cap, rate.

    rate = total x share / size, at most the cap. Without ``total`` it is the largest total at which no source needs more
    than its cap, so that all shares are met; a given larger total lets capped sources fall short. Sources
    with no target, a share of 0 or nothing in them get no rows or the rate 0.
    """
    t = targets.where(F.col(share).isNotNull() & F.col(source).isNotNull()).groupBy(source).agg(F.max(share).alias("share"), F.min(cap).alias("cap"))
    whole = t.agg(F.sum("share")).first()[0] or 1
    both = t.join(sizes.select(source, F.col(size).alias("size")), source).withColumn("part", F.col("share") / F.lit(float(whole)))
    reach = F.when((F.col("part") > 0) & (F.col("size") > 0), F.col("cap") * F.col("size") / F.col("part"))
    total = (both.agg(F.min(reach)).first()[0] or 0.0) if total is None else total
    rate = F.coalesce(F.try_divide(F.lit(float(total)) * F.col("part"), F.col("size")), F.lit(0.0))
    return both.select(source, "size", F.round("part", 6).alias("share"), "cap", F.least(F.col("cap").cast("double"), rate).alias("rate"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, share: str, cap: str,
    total: float | None = None, seed: int = 0, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(copies, rates): the mixture as source, doc_id, copy, n_tokens, and the rates it was drawn with.

    A text counts once: exact copies collapse to the row of smallest id among those whose source has a target (hashed
    and aggregated map-side, so a group of copies with a third of all rows is harmless), since otherwise a text could
    occur more often than its source allows. Every document is emitted floor(rate) times and once more where a hash of
    its id and the seed falls below the fraction, which any executor repeats alike.

    Defined cases: null, empty and blank texts and sources without target are left out; an empty table gives an empty
    mixture; names of sources are compared as given. Other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = documents.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).where("length(trim(text)) > 0")
    t = targets.select(F.col(source).alias("source"), F.col(share).alias("part"), F.col(cap).alias("most"))
    known = count_tokens(rows.join(t.select("source").distinct(), "source", "left_semi"), "text", "n_tokens", tokenizer)
    hashed = known.select("id", "source", "n_tokens", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("h3"))
    single = scratch.cut(
        hashed.groupBy("h1", "h2", "h3").agg(F.min_by(F.struct("id", "source", "n_tokens"), F.struct("id", "source")).alias("d")).select("d.*")
    )
    sizes = single.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    rates = scratch.cut(mixing_rates(sizes, t, "source", "n_tokens", "part", "most", total), 1)
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_UNITS)) / F.lit(float(_UNITS))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    drawn = single.join(rates.select("source", "rate"), "source").withColumn("copies", copies.cast("int")).where("copies > 0")
    out = drawn.select("source", F.col("id").alias(doc_id), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")
    return out, rates


def mixture_report(copies: DataFrame, rates: DataFrame) -> DataFrame:
    """Per source: tokens at hand, target share, cap, rate, emitted copies and tokens, actual share."""
    emitted = copies.groupBy("source").agg(F.count("*").alias("n_copies"), F.sum("n_tokens").alias("tokens"))
    emitted = rates.join(emitted, "source", "left").na.fill(0, ["n_copies", "tokens"])
    whole = emitted.agg(F.sum("tokens")).first()[0] or 0
    return emitted.select(
        "source", F.col("size").alias("available_tokens"), F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"),
        F.round("rate", 6).alias("rate"), "n_copies", "tokens", F.round(F.try_divide(F.col("tokens"), F.lit(whole)), 6).alias("actual_share"),
    )
