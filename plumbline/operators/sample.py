"""SAMPLE and SAMPLE BLOCK with SEED: rows, or blocks of rows, chosen by a keyed hash, so that reruns and any partitioning give the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(key: Column, seed: int) -> Column:
    """A number in [0, 2^32) by the first bytes of a hash of the seed and a key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def _text(key: Sequence[str]) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key))


def sample(df: DataFrame, percent: float, seed: int, key: Sequence[str]) -> DataFrame:
    """SAMPLE (percent) SEED (seed): each row with this probability, by a hash of its key; rows of one key go together, and a larger percentage takes the same rows and more."""
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    return df.where(_share(_text(key), seed) < int(percent / 100 * (1 << 32)))


def sample_blocks(df: DataFrame, percent: float, seed: int, block: Column | None = None) -> DataFrame:
    """SAMPLE BLOCK: whole blocks with this probability; a block is what has one value of a column, or else a file of the input, known by its name without folders."""
    key = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1) if block is None else F.coalesce(block.cast("string"), F.lit("\x00"))
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    return df.where(_share(key, seed) < int(percent / 100 * (1 << 32)))
