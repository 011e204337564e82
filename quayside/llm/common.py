"""What several operators share: reading a table, words, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import ship_package

# Fixed value: a word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str) -> Column:
    """The text column as it is, a null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: str) -> list[str]:
    """The words of a text, as :data:`WORD` defines them.

    Splitting bytes knows only the six ASCII white-space characters, whereas
    ``str.split`` would also split at others.
    """
    return [w.decode() for w in text.encode().split()]


def ready(spark: SparkSession) -> None:
    """Prepare a session for Python workers on texts: the package, and batches of bounded size.

    Arrow batches are cut by rows and by bytes, whichever comes first; with
    the defaults a worker may hold many large texts at once.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def beside(docs: DataFrame, used: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, which keeps all columns, with those it does not use under names that meet no name of its own."""
    named = {name: f"beside_{i}" for i, name in enumerate(docs.columns) if name not in used}
    return stage(docs.withColumnsRenamed(named)).withColumnsRenamed({new: old for old, new in named.items()})


def fold(id_text: Column, folds: int) -> Column:
    """The remainder that decides on which side of a split a row falls."""
    return F.crc32(id_text.cast("string")) % F.lit(folds)
