"""One row per key, always the same one, and whether the key's rows agree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.operators.numbering import Sources
from martloom.schemas import ROW_ORDER
from martloom.workspace import Saved, Workspace

# More keys than this are found by a hash join of shuffled rows, which sorts none of them. Only rows that a bitmap of
# the chosen places lets through are shuffled; it has this many bits a key or more, and 32 MB at most.
_HASHED_KEYS = 100_000
_BITS_A_KEY, _MOST_BITS = 16, 1 << 28


@dataclass(frozen=True)
class Survivors:
    """`rows`: per key the chosen row, whole. `keys`: the keys, and `differs`, by digests, for each."""

    rows: DataFrame
    keys: Saved


def _digests(rows: DataFrame, keys: Sequence[str]) -> list[Column]:
    """128 bits of a row's content as two longs. A hash skips NULLs, so each column comes with whether it is one."""
    content: list[Column] = []
    for name in rows.columns:
        if name not in (*keys, *ROW_ORDER):
            content += [F.col(name), F.col(name).isNull()]
    return [F.xxhash64(F.lit(seed), *content) for seed in (1, 2)]


def _perhaps_chosen(located: DataFrame, chosen: DataFrame, keys: int) -> DataFrame:
    """The rows whose place is chosen, and a few others whose hash meets one; rows do not move.

    More keys than the largest bitmap is meant for only let more of the others through.
    """
    bits = min(_MOST_BITS, 1 << (_BITS_A_KEY * keys).bit_length())
    at = F.pmod(F.xxhash64("_place"), F.lit(bits)) + 1
    bitmaps = chosen.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    position = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.getbit(byte, position % 8) == 1
    return located.join(F.broadcast(bitmaps), (F.bitmap_bucket_number(at) == F.col("_bucket")) & is_set, "left_semi")


def first_by(ws: Workspace, rows: DataFrame, keys: Sequence[str], sources: Sources) -> Survivors:
    """Per key the row that comes first by (source file, id), whole; those two columns are dropped.

    A row's place is one number, so the first per key is a hash aggregate over numbers, reduced before its
    shuffle: a key holding a third of the rows sends one row per task, and no wide row is sorted. Minima and
    maxima of digests ride along and say whether the rows of a key differ. The chosen rows are then found by key
    and place, of many keys only rows that a bitmap of the chosen places lets through: the wide rows stay where they
    lie. Only rows that tie on the place, where ids repeat in a file, are settled by their own content.
    """
    located = sources.located(rows, "_place")
    one, two = _digests(rows, keys)
    per_key = located.select(*keys, "_place", one.alias("_one"), two.alias("_two")).groupBy(*keys)
    ends = [end(c).alias(f"_{end.__name__}{c}") for c in ("_one", "_two") for end in (F.min, F.max)]
    first = per_key.agg(F.min("_place").alias("_place"), *ends)
    differs = (F.col("_min_one") != F.col("_max_one")) | (F.col("_min_two") != F.col("_max_two"))
    found = ws.save(first.select(*keys, "_place", differs.alias("differs")), "first-places")
    chosen = found.df.drop("differs")
    if found.rows > _HASHED_KEYS:
        located = _perhaps_chosen(located, chosen, found.rows)
        chosen = chosen.hint("shuffle_hash")
    rest = [c for c in rows.columns if c not in (*keys, *ROW_ORDER)]
    met = located.join(chosen, [*keys, "_place"]).select(*keys, *rest)
    if not sources.dense:
        met = met.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in rest])
    return Survivors(met, found)


def differing_keys(keys: DataFrame) -> DataFrame:
    """How many keys have rows that differ, so that one of them had to be chosen; told by 128-bit digests."""
    return keys.agg(F.count_if(F.col("differs")).alias("keys_with_differing_digests"))
