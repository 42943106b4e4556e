"""The contiguous-watermark committer of one partition, as a plain state machine.

It takes completions in any order and tells which offset may be committed: the highest
one up to which every delivered record is known to be finished, although offsets have
gaps.  A record is the successor of ``ready`` if its predecessor stamp says so, or of
the last commit.  What can't be told yet waits; what can never be committed is an orphan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

FIRST, BUFFERED, ORPHANED, DUPLICATE = 16, 32, 64, 128


@dataclass
class Item:
    offset: int
    prev: int
    first: bool = False
    read_us: int = 0
    traits: int = 0


@dataclass
class Committer:
    baseline: int = -1  # the next position to commit
    last: int = -1  # the record last committed in this epoch
    ready: Item | None = None
    waiting: list[Item] = field(default_factory=list)
    stamps: Counter = field(default_factory=Counter)  # predecessors of what waits, so that a taken record finds its successor at once
    advance: bool = False  # something that waits may have become the successor
    low: int | None = None
    high: int | None = None
    assigned: bool = False
    revoked: bool = False
    finished: list[Item] = field(default_factory=list)  # since they were last taken
    errors: int = 0

    def assign(self, baseline: int) -> None:
        if self.ready and self.ready.offset < baseline:
            self._orphan(self.ready)
            self.ready = None
        if self.revoked:
            if self.ready:
                self._orphan(self.ready)
            for x in self.waiting:
                self._orphan(x)
            self.ready = None
            self._waits([])
        self.baseline, self.last, self.assigned, self.revoked, self.advance = baseline, -1, True, False, bool(self.waiting)

    def revoke(self) -> None:
        self.assigned, self.revoked = False, True

    def complete(self, x: Item) -> None:
        self.low = x.offset if self.low is None else min(self.low, x.offset)
        self.high = x.offset if self.high is None else max(self.high, x.offset)
        if x.first:
            x.traits |= FIRST
            self.baseline = max(self.baseline, x.offset)
        if self.ready is None:
            if x.offset == self.baseline:
                self._take(x)
            elif x.offset < self.baseline:
                self._orphan(x)
            else:
                self._wait(x)
                self.advance |= self._follows_commit(x)
        elif x.offset < self.ready.offset:
            self._orphan(x)
        elif x.offset == self.ready.offset:
            self.errors += 1
            self._take(x)
        elif x.prev == self.ready.offset:
            self._take(x)
        else:
            self._wait(x)

    def flush(self) -> None:
        if not self.advance:
            return
        self.advance = False
        self.waiting.sort(key=lambda x: (x.offset, -x.read_us))
        kept: list[Item] = []
        for x in self.waiting:
            if not kept or kept[-1].offset != x.offset:
                kept.append(x)
        used = 0
        for x in kept:
            if self.ready is None:
                if x.offset < self.baseline:
                    self._orphan(x)
                elif x.offset == self.baseline or self._follows_commit(x):
                    self.ready = x
                else:
                    break
            elif x.offset <= self.ready.offset:
                self._orphan(x)
            elif x.prev == self.ready.offset:
                self.finished.append(self.ready)
                self.ready = x
            else:
                break
            used += 1
        self._waits(kept[used:])

    def tick(self, send: Callable[[int], bool] = lambda offset: True) -> int | None:
        """Commits what is ready; the committed offset, or None.  If ``send`` fails nothing changes."""
        self.flush()
        if not self.assigned:
            for x in [*([self.ready] if self.ready else []), *self.waiting]:
                self._orphan(x)
            self.ready, self.advance = None, False
            self._waits([])
            return None
        if self.ready is None:
            self._repair()
        if self.ready is None:
            return None
        if self.ready.offset < self.baseline:
            self._orphan(self.ready)
            self.ready, self.advance = None, bool(self.waiting)
            return None
        if not send(self.ready.offset):
            return None
        done = self.ready
        self.baseline, self.last = max(self.baseline, done.offset + 1), max(self.last, done.offset)
        self.finished.append(done)
        self.ready, self.advance = None, bool(self.waiting)
        return done.offset

    def take_finished(self) -> list[Item]:
        out, self.finished = self.finished, []
        return out

    @property
    def pending(self) -> bool:
        return self.ready is not None or bool(self.waiting)

    def snapshot(self) -> dict:
        committed = max(self.baseline - 1, -1)
        return {"committed": committed, "ready": self.ready.offset if self.ready else self.baseline - 1, "max_offset_seen": self.high, "gap_depth": len(self.waiting), "assigned": self.assigned}

    def _follows_commit(self, x: Item) -> bool:
        return self.last >= 0 and x.prev == self.last

    def _take(self, x: Item) -> None:
        if self.ready is not None:
            self.finished.append(self.ready)
        self.ready = x
        self.advance |= x.offset in self.stamps

    def _wait(self, x: Item) -> None:
        x.traits |= BUFFERED
        self.waiting.append(x)
        self.stamps[x.prev] += 1

    def _waits(self, items: list[Item]) -> None:
        self.waiting, self.stamps = items, Counter(x.prev for x in items)

    def _orphan(self, x: Item) -> None:
        x.traits |= ORPHANED
        self.finished.append(x)

    def _repair(self) -> None:
        """With nothing ready: the lowest waiting record that must be the successor, by its stamp."""
        if not self.waiting or self.advance or self.last < 0:
            return
        proven = [x for x in self.waiting if x.offset >= self.baseline and (x.offset == self.baseline or 0 <= x.prev <= self.last)]
        if not proven:
            return
        found = min(proven, key=lambda x: (x.offset, -x.read_us))
        for x in self.waiting:
            if x.offset < found.offset:
                self._orphan(x)
        self._waits([x for x in self.waiting if x.offset > found.offset])
        self.ready, self.advance = found, bool(self.waiting)
