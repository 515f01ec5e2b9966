"""SRC-19, SRC-20, SNK-15: contracts of remote services. No network code ships with the engine; a caller passes a function that fetches, and rows that need fetching come from sampling.pending()."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any


class RateLimit:
    """WIN-11: at most ``calls`` in ``seconds`` and ``day`` in a day."""

    def __init__(self, calls: int = 4, seconds: float = 60, day: int = 500, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.day, self.clock, self.sleep = calls, seconds, day, clock, sleep
        self.recent: deque[float] = deque()
        self.today: deque[float] = deque()

    def wait(self) -> None:
        for window, span, most in ((self.recent, self.seconds, self.calls), (self.today, 86_400, self.day)):
            now = self.clock()
            while window and window[0] <= now - span:
                window.popleft()
            if len(window) >= most:
                self.sleep(window[0] + span - now)
        now = self.clock()
        self.recent.append(now)
        self.today.append(now)


def fetched(keys: Iterable[str], fetch: Callable[[str], Any], limit: RateLimit, tries: int = 3) -> Iterator[tuple[str, Any, str | None]]:
    """(key, result, error) of each key, within the limit."""
    for k in keys:
        error = None
        for _ in range(tries):
            limit.wait()
            try:
                yield k, fetch(k), None
                break
            except Exception as e:  # noqa: BLE001  whatever the caller's function raises is reported
                error = str(e)
        else:
            yield k, None, error
