"""A filter of bounded size that keeps rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: bitmaps of at most 8 MB are broadcast, whatever the number of rows.
FILTER_BITS = 1 << 26
#: Bits of one bitmap of bitmap_construct_agg.
BITMAP = 1 << 15


def likely(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """rows without nearly all whose column `on` is not in ids; none of ids is left out. An exact join is to follow.

    Rows that only share the bit of one of ids stay too, so with very many ids more is shuffled, not less found.
    """
    place = F.pmod(F.xxhash64(on), F.lit(FILTER_BITS))
    split = [F.floor(place / BITMAP).alias("_bucket"), (place % BITMAP).alias("_bit")]
    bits = ids.select(*split).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    held = rows.select("*", *split).join(F.broadcast(bits), "_bucket").filter(F.getbit(byte, F.expr("cast(_bit % 8 as int)")) == 1)
    return held.select(*rows.columns)
