"""Progress of what runs, as lines of text, and counts of records taken from the pass that writes them."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@contextmanager
def progress(spark: SparkSession, label: str = "", every: float = 1.0, out: TextIO | None = None) -> Iterator[None]:
    """While its body runs, a line whenever the tasks done of the active stages have changed, and one at the end."""
    tracker, over, said = spark.sparkContext.statusTracker(), threading.Event(), out or sys.stderr
    finished: dict[int, int] = {}

    def watch() -> None:
        before = None
        while not over.wait(every):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
            now = [(s.stageId, s.numCompletedTasks, s.numTasks) for s in stages]
            finished.update({i: done for i, done, _ in now})
            if now and now != before:
                print(f"{label}: " * bool(label) + ", ".join(f"stage {i} {done} of {n} tasks" for i, done, n in now), file=said, flush=True)
            before = now

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        print(f"{label}: " * bool(label) + f"done, {len(finished)} stages seen", file=said, flush=True)


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows (`rows`) and of those that meet each condition. The counts come from the same
    pass as the first action on df and are there once it is over; a stream has them in its progress, see Totals."""
    seen = Observation(name)
    return df.observe(name if df.isStreaming else seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


class Totals(StreamingQueryListener):
    """Sums of the counts of a stream's batches by name, for spark.streams.addListener: totals[name][count]."""

    def __init__(self, out: TextIO | None = None):
        self.totals: dict[str, dict[str, int]] = {}
        self.batches, self.out, self.failed = 0, out, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        for name, row in event.progress.observedMetrics.items():
            into = self.totals.setdefault(name, {})
            for count, n in row.asDict().items():
                into[count] = into.get(count, 0) + n
            if self.out:
                print(f"{name}: " + ", ".join(f"{n} {count}" for count, n in into.items()), file=self.out, flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)
