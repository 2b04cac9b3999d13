"""Options of a store, checked when they are made."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class StoreOptions:
    """What a store is built from.

    key: column that routes an event (None: a hash of the whole event). seq: arrival order; unique.
    ts: event time, value: the default number to aggregate; each may be absent.
    capacity: of the whole store, takes the place of capacity_per_partition. Window sizes are in ticks.
    on_discarded gets the DataFrame of the events that an append pushed out, on_full nothing,
    on_stats a StoreStats row after every stats_interval appended events.
    """

    capacity_per_partition: int = 100_000
    partitions: int = os.cpu_count() or 1
    capacity: int | None = None
    key: str | None = None
    seq: str = "seq"
    ts: str | None = None
    value: str | None = None
    window_ticks: int | None = None
    bucket_count: int = 512
    bucket_ticks: int | None = None
    window_tracking: bool = True
    stats_interval: int = 1
    on_discarded: Callable[[DataFrame], None] | None = None
    on_full: Callable[[], None] | None = None
    on_stats: Callable[[dict], None] | None = None

    def __post_init__(self) -> None:
        positive = {"partitions": self.partitions, "bucket_count": self.bucket_count, "stats_interval": self.stats_interval}
        positive |= {"capacity_per_partition": self.capacity_per_partition}
        positive |= {"bucket_ticks": self.bucket_ticks} if self.bucket_ticks is not None else {}
        for name, n in positive.items():
            if n <= 0:
                raise ValueError(f"{name} must be greater than 0")
        if self.window_ticks is not None and self.bucket_ticks is not None:
            if self.window_ticks < self.bucket_ticks:
                raise ValueError("window_ticks must be at least bucket_ticks")
            if self.window_ticks % self.bucket_ticks:
                raise ValueError("window_ticks must be a multiple of bucket_ticks")

    @property
    def per_partition(self) -> int:
        """Events that a partition keeps."""
        return self.capacity_per_partition if self.capacity is None else max(1, self.capacity // self.partitions)

    @property
    def width(self) -> int | None:
        """Ticks of a bucket."""
        if self.bucket_ticks is not None or self.window_ticks is None:
            return self.bucket_ticks
        return max(1, self.window_ticks // self.bucket_count)
