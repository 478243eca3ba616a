"""Requests in flight: a bounded window of calls inside one task, with deadlines.

A task of Spark holds one window.  Calls run in threads, as they wait for servers;
results come as they end, or put back in order.  A failure is a result like any
other, so the rest goes on.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any, TypeVar

T = TypeVar("T")
R = TypeVar("R")
#: (place of the item, its result, what it failed with)
Ended = tuple[int, R | None, BaseException | None]


class RequestTimeout(TimeoutError):
    """No answer before the deadline."""


def in_flight(items: Iterable[T], call: Callable[[T], R], width: int, timeout_s: float | None = None) -> Iterator[Ended]:
    """Results as they end.  Up to `width` calls wait at a time; items are taken only when one of them may start.

    A thread cannot be stopped: past its deadline a call is given up, its place in
    the window is free, and what it may still return is dropped.  Of such threads
    there are no more than `width`; while so many hang, further calls fail at once.
    """
    if width < 1:
        raise ValueError("a window has room for one call at least")
    source = enumerate(items)
    if width == 1 and timeout_s is None:
        for i, item in source:
            yield _ended(i, call, item)
        return
    ended: queue.SimpleQueue[Ended] = queue.SimpleQueue()
    deadlines: dict[int, float] = {}
    given_up: set[int] = set()
    more = True
    while more or deadlines:
        while more and len(deadlines) < width:
            taken = next(source, None)
            if taken is None:
                more = False
                break
            while not ended.empty() and len(given_up) >= width:  # some may have ended meanwhile
                yield from _settle(ended.get(), deadlines, given_up)
            i, item = taken
            if len(given_up) >= width:
                yield i, None, RequestTimeout(f"not sent: {len(given_up)} requests are past their deadline of {timeout_s:g} s")
                continue
            deadlines[i] = time.monotonic() + timeout_s if timeout_s is not None else float("inf")
            threading.Thread(target=lambda i=i, item=item: ended.put(_ended(i, call, item)), daemon=True).start()
        if not deadlines:
            continue
        first = min(deadlines.values())
        try:
            yield from _settle(ended.get(timeout=None if first == float("inf") else max(0.0, first - time.monotonic())), deadlines, given_up)
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, at in deadlines.items() if at <= now]:
                del deadlines[i]
                given_up.add(i)
                yield i, None, RequestTimeout(f"no answer after {timeout_s:g} s")


def _ended(i: int, call: Callable[[T], R], item: T) -> Ended:
    try:
        return i, call(item), None
    except Exception as e:
        return i, None, e


def _settle(end: Ended, deadlines: dict[int, float], given_up: set[int]) -> Iterator[Ended]:
    given_up.discard(end[0])
    if deadlines.pop(end[0], None) is not None:
        yield end


def in_order(items: Iterable[T], call: Callable[[T], R], width: int, timeout_s: float | None = None) -> tuple[list[R | None], list[tuple[int, BaseException]]]:
    """All results in the order of the items, None where one failed, and the failures by place."""
    found = sorted(in_flight(items, call, width, timeout_s), key=lambda x: x[0])
    return [r for _, r, _ in found], [(i, e) for i, _, e in found if e is not None]


def batches_in_order(batches: Iterable[list[T]], call: Callable[[T], R], width: int, timeout_s: float | None = None) -> Iterator[list[tuple[R | None, BaseException | None]]]:
    """A list of results for each list of items.  The window stays full over their borders: the next one is begun while the last calls of one wait."""
    sizes: deque[int] = deque()

    def items() -> Iterator[T]:
        for batch in batches:
            sizes.append(len(batch))
            yield from batch

    held: dict[int, Any] = {}
    first = complete = 0
    for i, result, error in in_flight(items(), call, width, timeout_s):
        held[i] = result, error
        while complete in held:
            complete += 1
        while sizes and complete - first >= sizes[0]:
            size = sizes.popleft()
            yield [held.pop(first + k) for k in range(size)]
            first += size
    while sizes:  # what is left are lists without items
        sizes.popleft()
        yield []
