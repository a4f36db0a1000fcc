"""Nested time windows anchored at the prediction: ``seconds <= w``.

A row is repeated for each window that it belongs to and grouped once by (sample, window); the wide
form is made of those few rows at the end. One grouping with hundreds of filtered aggregates would
overrun the limits of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import aggregates as A


def sample():
    """Rows of a sample in their order."""
    return Window.partitionBy("sample_id").orderBy("row_seq")


#: The window of all rows of a sample.
WHOLE = float("inf")


def in_windows(rows: DataFrame, windows: tuple[float, ...]) -> DataFrame:
    """Rows once for each window ``w`` that holds them; ``WHOLE`` holds all."""
    every = F.array(*(F.lit(float(w)) for w in windows))
    return rows.withColumn("w", F.explode(F.filter(every, lambda w: (F.col("seconds") <= w) | (w == WHOLE))))


def grouped(derived: DataFrame, windows: tuple[float, ...], stats: dict[str, Column], only: set[str] | None = None) -> DataFrame:
    """(sample_id, w) with statistics, of which only the named ones are made if names are given."""
    made = [v.alias(k) for k, v in stats.items() if only is None or k in only]
    return in_windows(derived, windows).groupBy("sample_id", "w").agg(*(made or [F.count("*").alias("rows")]))


def with_lags(rows: DataFrame, *names: str) -> DataFrame:
    """Columns ``prev_<name>``, taken before any window cuts rows off."""
    return rows.withColumns({f"prev_{n}": F.lag(n).over(sample()) for n in names})


def transition() -> Column:
    """Both ends of the step from the row before lie in the window."""
    return F.coalesce((F.col("prev_seconds") <= F.col("w")) & (F.col("seconds") <= F.col("w")), F.lit(False))


def filled(v: Column, fallback: Column) -> Column:
    """The last value known, else the next one, else the fallback, within a sample."""
    back = sample().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = sample().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.coalesce(F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead), fallback)


def label_of(w: float) -> str:
    return f"{w:g}"


def wide(long: DataFrame, prefix: str, windows: tuple[float, ...], stats: dict[str, bool], whole: tuple[str, ...] = ()) -> DataFrame:
    """One row for each sample with columns ``<prefix>__w<W>__<stat>`` behind the statistics of whole samples,
    ``<prefix>__<stat>``. stats: whether an empty window counts as 0. Statistics that the rows lack are left out."""
    have = set(long.columns)
    stats, whole = {k: v for k, v in stats.items() if k in have}, [k for k in whole if k in have]
    held = F.map_from_entries(F.collect_list(F.struct(F.col("w"), F.struct(*stats, *whole).alias("s"))))
    rows = long.groupBy("sample_id").agg(held.alias("m"))

    def value(w: float, name: str) -> Column:
        v = F.try_element_at("m", F.lit(float(w)))[name]
        return (F.coalesce(v, F.lit(0.0)) if stats[name] else v).alias(f"{prefix}__w{label_of(w)}__{name}")

    every = (F.try_element_at("m", F.lit(WHOLE))[n].alias(f"{prefix}__{n}") for n in whole)
    return rows.select("sample_id", *every, *(value(w, n) for w in windows for n in stats))


def wide_events(derived: DataFrame, prefix: str, windows: tuple[float, ...], stats: dict[str, Column], empty: dict[str, bool], only: set[str] | None) -> DataFrame:
    """The wide block of order or transaction rows by one grouping: number and last time of a whole sample, then windows."""
    whole = {"row_count": F.count("*").cast("double"), "last_event_seconds": A.group_last(F.col("seconds"))}
    return wide(grouped(derived, with_whole(windows, whole, only), stats | whole, only), prefix, windows, empty, tuple(whole))


def with_whole(windows: tuple[float, ...], whole: dict[str, Column], only: set[str] | None) -> tuple[float, ...]:
    """The windows, and that of whole samples if one of its statistics is wanted."""
    return (*windows, WHOLE) if only is None or only & set(whole) else windows


def on_spine(spine: DataFrame, block: DataFrame, zeros: set[str]) -> DataFrame:
    """Every sample of the spine; samples without events have 0 for counts and sums."""
    return spine.join(block, "sample_id", "left").select("sample_id", *((F.coalesce(c, F.lit(0.0)).alias(c) if c in zeros else c) for c in block.columns if c != "sample_id"))


def spine(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample_id"))
