"""What a run did, counted while its rows pass by: for batches by observations, for streams by a listener."""

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What becomes of a file in a sync.
SYNC = ("insert", "duplicate", "unchanged", "debris")
#: What a change in a stream does to the files of a library.
STREAM = ("added", "changed", "removed")


def counts(kind: Column, kinds: tuple[str, ...]) -> list[Column]:
    return [F.count_if(kind == k).alias(k) for k in kinds]


def watched(rows: DataFrame, kinds: tuple[str, ...] = SYNC, kind: str = "action", name: str = "sync") -> tuple[DataFrame, Observation]:
    """rows, and an observation whose get is the number of rows of each kind once they have been through an action."""
    seen = Observation(name)
    return rows.observe(seen, *counts(F.col(kind), kinds)), seen


class Progress(StreamingQueryListener):
    """Sums of what streams observe, by name, over their batches; and how many batches there were."""

    def __init__(self) -> None:
        super().__init__()
        self.batches: dict[str, int] = defaultdict(int)
        self.sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.batches[name] += 1
            for kind, n in row.asDict().items():
                self.sums[name][kind] += n or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
