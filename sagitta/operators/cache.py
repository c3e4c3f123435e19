"""Results kept for a while, by the request that they answer and the version of the data that they come from."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame


class Results:
    """At most size cached frames, the least used go first; none is older than seconds or from another version."""

    def __init__(self, size: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.kept: OrderedDict[Hashable, tuple[float, Hashable, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], DataFrame], version: Hashable = None) -> DataFrame:
        found = self.kept.get(key)
        if found and self.clock() - found[0] <= self.seconds and found[1] == version:
            self.hits += 1
            self.kept.move_to_end(key)
            return found[2]
        self.misses += 1
        if found:
            self.drop(key)
        made = make().cache()
        self.kept[key] = (self.clock(), version, made)
        while len(self.kept) > self.size:
            self.drop(next(iter(self.kept)))
        return made

    def drop(self, key: Hashable) -> None:
        self.kept.pop(key)[2].unpersist()

    def clear(self) -> None:
        for key in list(self.kept):
            self.drop(key)

    def statistics(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self.kept), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
