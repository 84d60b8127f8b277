"""Which tiles of a blocked incidence meet: from postings (item -> bitmap of tiles), not from all pairs of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WORD = 64


def meeting_tiles(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """(*group, ti, tj): the tiles of ``left`` and ``right`` that hold a common item.

    Both sides have (*group, tile, item).  A posting is cut into words of 64 tiles, so a popular item has a row for each
    word and not one for each tile, and the words that a left tile meets are united before the tiles are listed.
    """
    word = F.floor(F.col("tile") / WORD).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(tile % {WORD} as int))")
    postings = right.groupBy(*group, "item", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    met = left.select(*group, "item", F.col("tile").alias("ti")).distinct().join(postings, [*group, "item"])
    united = met.groupBy(*group, "ti", "word").agg(F.bit_or("bits").alias("bits"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit(F.col("bits"), k) == 1)
    return united.select(*group, "ti", F.explode(F.transform(inside, lambda k: F.col("word") * WORD + k)).alias("tj"))
