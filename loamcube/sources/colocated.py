"""Tables stored for joins with each other: in buckets of the same keys, so that neither side is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamcube.schemas import PIXEL

#: What predictions, references and masks of pixels meet by.
OBSERVATION = (*PIXEL, "doy")


def write_colocated(df: DataFrame, name: str, path: str, keys: tuple[str, ...] = OBSERVATION, buckets: int = 200) -> DataFrame:
    """``df`` as table ``name`` at ``path``, in ``buckets`` of ``keys``, one sorted file each; tables of equal keys and number meet without a shuffle.

    Choose the number by the largest table, some 100 MB a bucket. Small tables may have it too: empty buckets cost nothing.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def with_cell(fine: DataFrame, factor: int, row: str = "r", col: str = "c") -> DataFrame:
    """Fine cells with the coarse cell over them (``_r``, ``_c``), to be stored in buckets of it beside the coarse cells."""
    return fine.withColumns({f"_{x}": F.floor(F.col(c) / factor).cast("int") for x, c in (("r", row), ("c", col))})
