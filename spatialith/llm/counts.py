"""Tables of counts by word hash: which words are frequent enough to be sent to all tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, column: str, k: int) -> Column:
    """Whether a word is among about the ``k`` most frequent by ``column``: all above a level, and at it the least hashes.

    Hashes are uniform, so a share of them cuts the ties at the level, however many; a few more than ``k`` may come.
    """
    above = 0
    by_count = counts.filter(F.col(column) > 0).groupBy(column).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc(column))
    for r in by_count.toLocalIterator():
        if above + r.words >= k:
            rest = k - above
            share = min(1.0, (rest + 6 * math.sqrt(rest) + 64) / r.words)
            last = min((1 << 63) - 1, int(share * 2**64) - (1 << 63))
            return (F.col(column) > r[column]) | ((F.col(column) == r[column]) & (F.col("w") <= last))
        above += r.words
    return F.col(column) > 0
