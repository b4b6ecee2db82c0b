"""When a snapshot of a table is due."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SnapshotPolicy:
    """Bounds on events (writes) and seconds between snapshots. Between the bounds in time, a snapshot is due once the
    events since the last one pass `multiplier` times what the present rate brings in `least_s`, within the bounds on
    writes: busy tables wait for more events, quiet ones for fewer."""

    least_writes: int = 1_000
    most_writes: int = 100_000
    least_s: float = 60
    most_s: float = 3600
    multiplier: float = 1.5
    adaptive: bool = True

    def threshold(self, rate: float) -> float:
        """Events that make a snapshot due where `rate` come a second."""
        return min(max(self.multiplier * rate * self.least_s, self.least_writes), self.most_writes)

    def due(self, writes: int, seconds: float) -> bool:
        """Whether one is due after so many events in so many seconds; without events there is nothing to keep."""
        if not self.adaptive:
            return writes >= self.most_writes
        if not writes or seconds < self.least_s:
            return False
        return seconds >= self.most_s or writes >= self.threshold(writes / seconds)
