"""A blocked Bloom filter as a column of words.

A key sets ``PROBES`` bits of one 64-bit word, so that a look-up reads one word. The number of words is a fixed
parameter and bounds what is sent to the tasks; a list that outgrows it raises the share of false positives and
changes no result, because hits are checked exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import free

PROBES = 4
# 2^16 words are 512 kB; with 16 bits a key that is good for 260,000 keys at a false positive rate below 1 %.
LOG2_WORDS = 16


def _word_and_mask(spread: Column, log2_words: int) -> tuple[Column, Column]:
    """The number of a hash's word (from 0) and its bits."""
    word = F.shiftrightunsigned(spread, 64 - log2_words).cast("int")
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return word, mask


def build(keys: DataFrame, key: list[str], log2_words: int = LOG2_WORDS) -> DataFrame:
    """One row with the array of words; the tasks send a partial OR per word."""
    word, mask = _word_and_mask(F.xxhash64(*key), log2_words)
    bits = keys.select(word.cast("bigint").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    every = keys.sparkSession.range(1 << log2_words).withColumnRenamed("id", "word").join(bits, "word", "left")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))


def split(rows: DataFrame, keys: DataFrame, of: list[Column], log2_words: int = LOG2_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ``keys``, and rows whose key is not: only the former have to be joined.

    ``keys`` is read more than once and has the key's columns in the order of ``of``. A key that was built in always
    passes.
    """
    # A generator, so that the hash is a column and the key is not worked out again for each use of it.
    spread = free("_spread", rows)
    hashed = rows.withColumn(spread, F.explode(F.array(F.xxhash64(*of))))
    words = build(keys, keys.columns, log2_words).scalar()
    word, mask = _word_and_mask(F.col(spread), log2_words)
    held = F.get(words, word).bitwiseAND(mask) == mask
    return hashed.where(held).drop(spread), hashed.where(~held).drop(spread)
