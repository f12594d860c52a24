"""Resampling with replacement, exactly and in one pass: how often each item is drawn is found where the item lies.

n draws of n items give multinomial counts. They are split in two again and again: of the draws that fall into a range of
items, those of its left half are binomial. The generator of a split is seeded by the group and the range, so every task
that meets a range splits it alike, and no task needs another's draws. Items are numbered, packed in blocks of a fixed
number, and a task walks down to its blocks, spreads a block's draws over its items, and multiplies the counts by the
items' values. So nothing is joined, and what is shuffled after the items themselves is one sum for each draw and value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered

BLOCK = 256
# Sums that a task holds before it sends them on, in bytes.
HELD_BYTES = 64 << 20


def _generator(seed: int, group: str, *place: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(group.encode()), *place])


class Splits:
    """Draws of one group by range of blocks; the halves met last are kept."""

    def __init__(self, seed: int, group: str, n: int, draws: int) -> None:
        self.seed, self.group, self.n, self.draws = seed, group, n, draws
        self.blocks = -(-n // BLOCK)
        self.left = lru_cache(maxsize=64)(self._left)

    def _items(self, lo: int, hi: int) -> int:
        return min(hi * BLOCK, self.n) - lo * BLOCK

    def _left(self, lo: int, hi: int) -> np.ndarray:
        middle = (lo + hi) // 2
        return _generator(self.seed, self.group, 1, lo, hi).binomial(self.of_range(lo, hi), self._items(lo, middle) / self._items(lo, hi))

    def of_range(self, lo: int, hi: int) -> np.ndarray:
        """[draw]: how many of the n draws fall into blocks lo to hi - 1, a range of the halving."""
        a, b, drawn = 0, self.blocks, np.full(self.draws, self.n)
        while (a, b) != (lo, hi):
            middle = (a + b) // 2
            left = self.left(a, b)
            a, b, drawn = (a, middle, left) if hi <= middle else (middle, b, drawn - left)
        return drawn

    def counts(self, block: int) -> np.ndarray:
        """[draw, item of the block]: how often each is drawn."""
        drawn, m = self.of_range(block, block + 1), self._items(block, block + 1)
        places = _generator(self.seed, self.group, 2, block).integers(0, m, int(drawn.sum()))
        return np.bincount(np.repeat(np.arange(self.draws), drawn) * m + places, minlength=self.draws * m).reshape(self.draws, m)


def resampled_sums(items: DataFrame, group: str, order: str, values: list[str], draws: int, seed: int = 42) -> DataFrame:
    """(group, draw, values): per group and draw the sums of the values over as many items as the group has, drawn with replacement.

    order tells items of a group apart and numbers them. A null value counts as zero.
    """
    named = items.select(F.col(group).cast("string").alias("_g"), F.col(order).alias("_o"), F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values]).alias("_v"))
    placed = numbered(named, "_g", "_o", "_i")
    sizes = named.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor((F.col("_i") - 1) / BLOCK).cast("long")
    blocks = placed.groupBy("_g", block.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_rows")).join(sizes, "_g")
    width = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        splits: dict[str, Splits] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for g, sums in held.items():
                columns = [pa.array(np.repeat(g, draws)), pa.array(np.arange(draws)), *(pa.array(sums[:, k]) for k in range(width))]
                yield pa.RecordBatch.from_arrays(columns, ["_g", "draw", *(f"_s{k}" for k in range(width))])
            held.clear()
            splits.clear()

        for batch in batches:
            for g, b, rows, n in zip(*(batch.column(i) for i in range(4)), strict=True):
                g, rows = g.as_py(), rows.values
                if g not in splits:
                    splits[g] = Splits(seed, g, n.as_py(), draws)
                v = rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
                held[g] = held.get(g, 0.0) + splits[g].counts(b.as_py()) @ v
                if len(held) * draws * width * 8 > HELD_BYTES:
                    yield from sent()
        yield from sent()

    ddl = "_g string, draw long, " + ", ".join(f"_s{k} double" for k in range(width))
    each = blocks.select("_g", "_b", "_rows", "_n").sortWithinPartitions("_g", "_b").mapInArrow(run, ddl)
    return each.groupBy("_g", "draw").agg(*[F.sum(f"_s{k}").alias(v) for k, v in enumerate(values)]).withColumnRenamed("_g", group)
