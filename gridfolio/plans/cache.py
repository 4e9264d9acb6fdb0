"""Bounded caches of the driver with an age limit and counters: embeddings of questions, and results."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field


@dataclass
class Cache:
    """Values by key, at most ``most`` of them and none older than ``seconds``.

    When full, what is too old goes first, then what was put in first. ``clock`` gives seconds.
    """

    seconds: float
    most: int
    clock: Callable[[], float] = time.monotonic
    hits: int = 0
    misses: int = 0
    held: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        """The value of a key, made where none is at hand. What can't be made isn't remembered."""
        found = self.held.get(key)
        if found is not None and self.clock() - found[0] <= self.seconds:
            self.hits += 1
            return found[1]
        self.misses += 1
        value = make()
        self.held.pop(key, None)
        if len(self.held) >= self.most:
            now = self.clock()
            for old in [k for k, (at, _) in self.held.items() if now - at > self.seconds]:
                del self.held[old]
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
        self.held[key] = (self.clock(), value)
        return value

    def forget(self) -> None:
        self.held.clear()

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses}
