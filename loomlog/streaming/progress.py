"""Running totals of what streams report through observe()."""

from __future__ import annotations

from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Counts the events that watermarks left out, by query name or id."""

    def __init__(self):
        self.totals: Counter = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        if late:
            self.totals[progress.name or str(progress.id)] += late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


class IngestCounters(StreamingQueryListener):
    """Adds up the accepted and rejected counts of every micro-batch; see plans.ingest.counted.

    Register with ``spark.streams.addListener``.
    """

    def __init__(self, name: str = "ingest"):
        self.name = name
        self.totals: Counter = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.totals.update(accepted=seen["accepted"], rejected=seen["rejected"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
