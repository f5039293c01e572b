"""Streams of access units: a simulator, filters, and the check of sequence numbers as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from omiclake.operators.filters import UnitFilter


def simulated(rows: DataFrame, interval: float = 0.1, peaks: int = 200, seed: int = 42, every: int = 5) -> DataFrame:
    """Spectra of a column value (0, 1, ...): every so many is a first-level one, peaks vary by a quarter and ascend in m/z.

    Numbers are hashes of seed, ordinal and peak, so batch and stream agree and reruns repeat.
    """
    unit = lambda *x: F.pmod(F.xxhash64(*x, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = (peaks - peaks // 4 + F.floor(unit(F.col("value"), F.lit(-1)) * (peaks // 2 + 1))).cast("int")
    ks = F.sequence(F.lit(0), n - 1)
    mz = F.array_sort(F.transform(ks, lambda k: 100.0 + 1900.0 * unit(F.col("value"), k, F.lit(1))))
    intensity = F.transform(ks, lambda k: 1e6 * unit(F.col("value"), k, F.lit(2)))
    out = rows.select(F.col("value").alias("au_sequence"), (F.col("value") * interval).alias("retention_time"), F.when(F.col("value") % every == 0, 1).otherwise(2).alias("ms_level"), mz.alias("mz"), intensity.alias("intensity"))
    top = F.array_max("intensity")
    return out.withColumn("base_peak_intensity", top).withColumn("base_peak_mz", F.element_at("mz", F.array_position("intensity", top).cast("int")))


def simulated_stream(spark: SparkSession, per_second: int = 10, **options) -> DataFrame:
    """The simulator on a clock."""
    return simulated(spark.readStream.format("rate").option("rowsPerSecond", per_second).load(), **options)


def filtered(units: DataFrame, text: str | None) -> DataFrame:
    """A client's JSON filter on a stream or a table; max_au needs a table."""
    f = UnitFilter.from_json(text)
    return units.where(f.column()) if units.isStreaming else f.on(units)


CHECKED = "dataset_id bigint, au_sequence bigint, ok boolean"


def sequence_checked(units: DataFrame) -> DataFrame:
    """dataset_id, au_sequence and ok of a stream: a dataset's numbers must grow, gaps are legal. State: the last number of each dataset."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        for f in frames:
            f = f.sort_values("arrival", kind="stable")
            before = f["au_sequence"].cummax().shift(fill_value=last).clip(lower=last)
            yield pd.DataFrame({"dataset_id": f["dataset_id"], "au_sequence": f["au_sequence"], "ok": f["au_sequence"] > before})
            last = max(last, int(f["au_sequence"].max()))
        state.update((last,))

    return units.groupBy("dataset_id").applyInPandasWithState(check, CHECKED, "last bigint", "append", GroupStateTimeout.NoTimeout)
