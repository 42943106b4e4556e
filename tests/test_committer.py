"""Golden sequences and a seeded model of the committer."""

import random

import pytest

from tidemark.streaming.committer import BUFFERED, ORPHANED, Committer, Item


def run(pairs, baseline=None, seed=None):
    c = Committer()
    c.assign(-1 if baseline is None else baseline)
    items = [Item(o, p, k == 0) for k, (o, p) in enumerate(pairs)]
    if seed is not None:
        random.Random(seed).shuffle(items)
    for x in items:
        c.complete(x)
    c.flush()
    return c, c.tick()


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("pairs,high", [
    ([(0, -1), (1, 0), (2, 1), (10, 2), (11, 10), (12, 11)], 12),
    ([(0, -1), (1, 0), (5, 1), (6, 5), (10, 6), (11, 10), (20, 11), (21, 20)], 21),
    ([(0, -1), (50, 0), (75, 50), (76, 75)], 76),
    ([(0, -1), (999999, 0)], 999999),
    ([(100, 99), (101, 100), (110, 101), (111, 110)], 111),
])
def test_gaps(pairs, high, seed):
    c, committed = run(pairs, seed=seed)
    assert committed == high and not c.pending
    assert sorted(x.offset for x in c.take_finished()) == [o for o, _ in pairs]


def test_holes_hold_the_commit():
    c, committed = run([(0, -1), (1, 0), (3, 2), (4, 3)])
    assert committed == 1 and [x.offset for x in c.waiting] == [3, 4] and c.waiting[0].traits & BUFFERED
    assert c.tick() is None
    c.complete(Item(2, 1))
    c.complete(Item(3, 2, read_us=9))
    assert c.tick() == 4 and not c.pending


def test_duplicate_while_ready():
    c = Committer()
    c.assign(-1)
    for o, p in ((0, -1), (1, 0), (2, 1), (3, 2), (3, 2), (4, 3), (5, 4)):
        c.complete(Item(o, p, o == 0))
    assert c.errors == 1 and c.tick() == 5 and [x.offset for x in c.take_finished()] == [0, 1, 2, 3, 3, 4, 5]


def test_twin_with_the_later_read_survives():
    for order in ((0, 1), (1, 0)):
        c = Committer()
        c.assign(8)
        c.complete(Item(8, 7, True))
        assert c.tick() == 8
        twins = [Item(12, 11, read_us=0), Item(12, 8, read_us=1_000_000)]
        for k in order:
            c.complete(twins[k])
        c.flush()
        assert c.tick() == 12 and not c.pending


def test_repair():
    c = Committer()
    c.assign(8)
    c.complete(Item(8, 7, True))
    assert c.tick() == 8
    a = Item(11, 10)
    c.complete(a)
    c.complete(Item(12, 8))
    c.flush()
    assert c.tick() == 12 and a.traits & ORPHANED and c.baseline == 13 and not c.pending


def test_no_repair_past_a_hole():
    c = Committer()
    c.assign(8)
    c.complete(Item(8, 7, True))
    assert c.tick() == 8
    for o, p in ((11, 10), (13, 12), (7, -1)):
        c.complete(Item(o, p))
    for _ in range(3):
        assert c.tick() is None
    assert [x.offset for x in c.waiting] == [11, 13]
    fresh = Committer()
    fresh.assign(5)
    fresh.complete(Item(9, 4))
    assert fresh.tick() is None and fresh.waiting


def test_commit_boundary_and_retention_jump():
    c = Committer()
    c.assign(1000)
    c.complete(Item(1000, 999, True))
    c.complete(Item(1001, 1000))
    assert c.tick() == 1001
    c.complete(Item(5_000_000, 1001))
    c.flush()
    assert c.tick() == 5_000_000
    c.complete(Item(5_000_001, 5_000_000))
    assert c.tick() == 5_000_001 and c.baseline == 5_000_002 and not c.pending


def test_epochs():
    c = Committer()
    c.assign(100)
    c.complete(Item(100, 99))
    late = Item(105, 104)
    c.complete(late)
    c.revoke()
    c.assign(0)
    assert late.traits & ORPHANED and not c.pending
    c.complete(Item(150, 149, True))
    assert c.tick() == 150
    c.revoke()
    c.complete(Item(151, 150))
    assert c.tick() is None and not c.pending


def test_failed_send_changes_nothing():
    c = Committer()
    c.assign(0)
    c.complete(Item(0, -1))
    assert c.tick(lambda o: False) is None and c.ready.offset == 0 and c.tick() == 0


@pytest.mark.parametrize("seed", range(60))
def test_model(seed):
    """Commits rise, never pass unfinished work, and reach the end; every record finishes once."""
    r = random.Random(seed)
    c, offsets, o = Committer(), [], r.randint(0, 2)
    for _ in range(120):
        offsets.append(o)
        o += 1 + (r.randint(1, 3) if r.random() < 0.25 else 0)
    c.assign(r.choice((-1, offsets[0])))
    items = [Item(x, offsets[k - 1] if k else x - 1, k == 0) for k, x in enumerate(offsets)]
    flight, given, done, last = [], 0, set(), -1
    while given < len(items) or flight or c.pending:
        for _ in range(r.randint(0, 8)):
            if given < len(items):
                flight.append(items[given])
                given += 1
        r.shuffle(flight)
        for _ in range(r.randint(0, 6)):
            if flight:
                x = flight.pop()
                done.add(x.offset)
                c.complete(x)
        if r.random() < 0.5:
            c.flush()
        sent = c.tick(lambda _: r.random() > 0.2)
        if sent is not None:
            assert sent > last and all(x in done for x in offsets if x <= sent)
            last = sent
    assert last == offsets[-1]
    finished = c.take_finished()
    assert sorted(x.offset for x in finished) == offsets and not any(x.traits & ORPHANED for x in finished)


def test_a_hole_doesnt_slow_the_rest():
    """Completions behind a hole, in reverse: each is looked up by its stamp, not compared with all that wait."""
    import time

    c, n = Committer(), 60_000
    c.assign(0)
    began = time.perf_counter()
    for o in range(n, 1, -1):
        c.complete(Item(o, o - 1))
    c.complete(Item(0, -1))
    assert c.tick() == 0 and len(c.waiting) == n - 1
    c.complete(Item(1, 0))
    assert c.tick() == n and not c.pending and not c.stamps and time.perf_counter() - began < 5
