"""A mergeable Bloom sketch of keys, as rows (word, bits).

A key sets ``PROBES`` bits of one 64-bit word, so one equi-join with the words answers for it.  There are at most
``WORDS`` words: this bounds what is broadcast, whatever the number of keys.  Sketches are merged by ``bit_or``.  The
more keys, the more words say yes to a new one: that costs a comparison, never a wrong answer (at 10 bits a key, 7
million keys here, for a few percent of the new ones).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 64 Mi bits; 16 bytes a row: 16 MiB broadcast at most
PROBES = 4


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS))


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))  # independent of the word
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [one(k) for k in range(PROBES)])


def sketch_of(keys: DataFrame, key_col: str) -> DataFrame:
    """The sketch of the non-NULL keys: partially aggregated, at most ``WORDS`` rows a task."""
    key = F.col(key_col)
    return (keys.where(key.isNotNull()).groupBy(_word(key).alias("word"))
            .agg(F.bit_or(_bits(key)).alias("bits")))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def might_contain(rows: DataFrame, key_col: str, sketch: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: False where the sketch proves that it does not hold the key (or the key is NULL)."""
    words = F.broadcast(merged(sketch).select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    bits = _bits(F.col(key_col))
    found = rows.join(words, _word(F.col(key_col)) == F.col("_word"), "left")
    hit = F.col("_bits").bitwiseAND(bits) == bits
    return found.withColumn(name, F.coalesce(hit, F.lit(False)) & F.col(key_col).isNotNull()).drop("_word", "_bits")
