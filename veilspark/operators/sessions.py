"""A cache of session vaults: idle time to live, and least-recently-used eviction by sessions, mappings and bytes.

The limits are over all sessions of a cache, so uses of one cache run in time order in one place; caches are told apart by
shard, and each shard is a group. What is kept in memory is what the limits allow, however long the input is.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes charged for a session and for a mapping beside its value and token.
SESSION_BYTES, MAPPING_BYTES, TOKEN_BYTES = 512, 256, 32


@dataclass
class Limits:
    ttl_s: int = 1800
    sessions: int = 128
    mappings: int = 16_384
    held_bytes: int = 16 << 20


@dataclass
class Cache:
    limits: Limits = field(default_factory=Limits)
    held: OrderedDict = field(default_factory=OrderedDict)  # key -> (last use, {value: cost}), least recently used first
    mappings: int = 0
    held_bytes: int = 0

    def _drop(self, key: str) -> None:
        _, values = self.held.pop(key)
        self.mappings -= len(values)
        self.held_bytes -= SESSION_BYTES + sum(values.values())

    def _full(self, more: int, cost: int) -> bool:
        return self.mappings + more > self.limits.mappings or self.held_bytes + cost > self.limits.held_bytes

    def use(self, at: float, key: str, value: str) -> str:
        """hit, stored or local: the value was known in its session, is known from now on, or fits in no cache."""
        for old in [k for k, (last, _) in self.held.items() if at - last >= self.limits.ttl_s]:
            self._drop(old)
        if key in self.held:
            self.held[key] = (at, self.held.pop(key)[1])
        else:
            while self.held and (len(self.held) >= self.limits.sessions or self._full(0, SESSION_BYTES)):
                self._drop(next(iter(self.held)))
            self.held[key] = (at, {})
            self.held_bytes += SESSION_BYTES
        values = self.held[key][1]
        if value in values:
            return "hit"
        cost = len(value.encode()) + TOKEN_BYTES + MAPPING_BYTES
        while self._full(1, cost) and next(iter(self.held)) != key:
            self._drop(next(iter(self.held)))
        if self._full(1, cost):  # its own session is never evicted for it
            return "local"
        values[value] = cost
        self.mappings += 1
        self.held_bytes += cost
        return "stored"


def replay(events: DataFrame, limits: Limits, shard: str = "shard") -> DataFrame:
    """id, key, result, sessions, held_bytes after each use, of rows (shard, at double, id long, key, value).

    A shard's uses run in order through one task, as a stream: what is in memory is one cache, never the shard's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, cache = None, Cache(limits)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.shard != here:
                    here, cache = r.shard, Cache(limits)
                out.append((r.id, r.key, cache.use(r.at, r.key, r.value), len(cache.held), cache.held_bytes))
            yield pd.DataFrame(out, columns=["id", "key", "result", "sessions", "held_bytes"])

    dealt = events.select(F.col(shard).alias("shard"), "at", "id", "key", "value").repartition("shard").sortWithinPartitions("shard", "at", "id")
    return dealt.mapInPandas(run, "id long, key string, result string, sessions int, held_bytes long")
