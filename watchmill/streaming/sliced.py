"""Streamed profiles with slices and several granularities, and their repair from rows that came late (ST1, ST5, ST6).

Every micro-batch adds its partial profiles per base window to a table, under its own batch id: a batch that is played again
replaces what it left, and its ledger row, the last write, makes it visible. Partials merge to any window, so the stream keeps no
state in memory, needs no limit on the number of open windows, and one stored row serves all granularities and slices.

A window is closed once its end lies ``delay`` behind the latest instant of the batches before. Closed windows are published
as they were when they closed. Rows that come for closed base windows are stored apart as they are, and their partials too
are kept, so that touched windows can be made anew without reading the source again, or from it by ``touched_profile``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.functions.windows import as_instant, base_granularity, window_end, window_start
from watchmill.operators.grouping import fan_out, name_at
from watchmill.operators.profile import merge_parts, partial_profiles, profile_columns
from watchmill.settings import Monitor

_LEDGER = "latest timestamp_ntz, batch int"


@dataclass(frozen=True)
class SlicedStream:
    """The stored parts of one stream's profile. ``distinct`` is 'approx' or 'none', as sketches merge and counts do not.

    Null instants belong to no window. An empty batch adds nothing and closes nothing. Only one query may feed a folder.
    """

    spark: SparkSession
    path: str
    monitor: Monitor
    delay: str = "10 minutes"
    distinct: str = "approx"

    def __post_init__(self) -> None:
        if not self.monitor.granularities:
            raise ValueError("a stream is profiled by windows: name a granularity")
        if self.distinct not in ("approx", "none"):
            raise ValueError(f"distinct counts of a stream are 'approx' or 'none', not {self.distinct!r}")

    def run_available(self, stream: DataFrame) -> None:
        """Take in what is there and stop; the next run goes on from there."""
        writer = stream.writeStream.foreachBatch(self.take_in).option("checkpointLocation", f"{self.path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()

    def take_in(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro-batch; one that is complete already is passed over."""
        last, closed = self._closed(before=batch_id)
        if last is not None and last >= batch_id:
            return
        batch = batch.persist()
        mark = F.lit(closed).cast("timestamp_ntz")
        parts = partial_profiles(batch, self.monitor, distinct_sketch=self.distinct == "approx")
        self._write(parts.withColumn("closed", mark), "parts", batch_id)

        base = base_granularity(self.monitor.granularities)
        dated = batch.withColumn("__at", as_instant(batch, self.monitor.timestamp_column))
        end = window_end(window_start("__at", base), F.lit(base))
        self._write(dated.filter(end <= mark).drop("__at"), "late", batch_id)
        self._write(dated.agg(F.max("__at").alias("latest")), "ledger", batch_id)
        batch.unpersist()

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _closed(self, before: int | None = None) -> tuple[int | None, str | None]:
        """The last complete batch, and the instant up to which windows are closed by the batches before one (or by all)."""
        try:
            rows = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, None
        known = F.col("latest") if before is None else F.when(F.col("batch") < before, F.col("latest"))
        closed = F.max(known) - F.expr(f"INTERVAL {self.delay}")
        row = rows.agg(F.max("batch").alias("last"), closed.cast("string").alias("closed")).first()
        return row.last, row.closed

    def _read(self, name: str) -> DataFrame:
        last, _ = self._closed()
        if last is None:
            raise ValueError(f"no batch is complete in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("batch") <= last)

    def _spread(self) -> DataFrame:
        """Parts of every window and slice, with the window's end and whether it had closed before they came."""
        spread = fan_out(self._read("parts"), self.monitor)
        end = window_end(F.col("g.window_start"), name_at(F.col("g.granularity"), self.monitor.granularities))
        return spread.withColumn("__late", F.coalesce(end <= F.col("closed"), F.lit(False))).withColumn("__end", end)

    def _is_closed(self) -> Column:
        _, closed = self._closed()
        return F.col("__end") <= F.lit(closed).cast("timestamp_ntz")

    def _profile(self, spread: DataFrame) -> DataFrame:
        merged = merge_parts(spread.drop("__late", "__end"), self.monitor)
        sketched = F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0).cast("bigint")) if self.distinct == "approx" else F.lit(None).cast("bigint")
        return merged.select(*profile_columns(self.monitor, sketched, "INPUT"))

    def late_rows(self) -> DataFrame:
        """ST5: the rows that came for closed base windows, as they came, with their ``batch``."""
        return self._read("late")

    def published(self) -> DataFrame:
        """ST1: closed windows, as they were when they closed."""
        return self._profile(self._spread().filter(self._is_closed() & ~F.col("__late")))

    def touched(self) -> DataFrame:
        """ST4: (granularity, window_start) of the closed windows that rows came late for; granularities by position."""
        return self._spread().filter("__late").select("g.granularity", "g.window_start").distinct()

    def repaired(self) -> DataFrame:
        """ST4, ST5: fresh rows of the touched windows, all slices, made from parts alone."""
        place = F.struct("g.granularity", "g.window_start")
        touched = self.touched().select(F.struct("granularity", "window_start").alias("__place"))
        return self._profile(self._spread().join(touched, place == F.col("__place"), "left_semi"))

    def profile(self) -> DataFrame:
        """All windows from all rows so far, open ones and late rows included: what a batch over the same rows gives."""
        return self._profile(self._spread())
