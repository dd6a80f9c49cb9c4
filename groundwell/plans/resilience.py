"""For clients of models inside a Python worker: which errors to repeat, with what pauses, and when to stop asking."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import ModelError

#: Replies worth another try, besides all from 500 on.
RETRYABLE = (408, 429)


def retryable(error: BaseException) -> bool:
    """A time-out, a lost connection, or a reply whose ``status`` says that it may pass."""
    code = getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or isinstance(code, int) and (code in RETRYABLE or code >= 500)


def with_retry(call: Callable, *, attempts: int = 3, first_pause: float = 0.5, most_pause: float = 8.0, sleep=time.sleep):
    """``call()``, repeated with doubling pauses while its errors are retryable; the last error is raised."""
    for turn in range(attempts):
        try:
            return call()
        except Exception as error:
            if turn + 1 == attempts or not retryable(error):
                raise
            sleep(min(most_pause, first_pause * 2**turn))


@dataclass
class CircuitBreaker:
    """closed: calls pass; open after ``failures`` errors in a row: calls are refused for ``pause`` seconds; then half open: one call decides."""

    failures: int = 5
    pause: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _count: int = field(default=0, init=False)
    _since: float | None = field(default=None, init=False)

    @property
    def state(self) -> str:
        if self._since is None:
            return "closed"
        return "half_open" if self.clock() - self._since >= self.pause else "open"

    def call(self, run: Callable):
        before = self.state
        if before == "open":
            raise ModelError("the model is not asked for a while, after repeated failures")
        try:
            out = run()
        except Exception:
            self._count += 1
            if before == "half_open" or self._count >= self.failures:
                self._since = self.clock()
            raise
        self._count, self._since = 0, None
        return out
