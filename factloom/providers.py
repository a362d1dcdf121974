"""Providers of answers: keys used in turn, waits, retries and a second provider where the first fails.

A provider is a function ``(key, prompt) -> text`` that raises ``Refused`` with the status and message of a
failed call, or an ``OSError`` where nothing came back. Nothing here is bound to a network library.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

Ask = Callable[[str, str], str]
#: Attempts of one call, the first and longest wait in seconds, the rest of a key whose message names none.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, DEFAULT_REST = 6, 2.0, 60.0, 60.0
#: How messages name a limit for the day, and a wait.
_DAY = re.compile(r"\b(?:requests|tokens)\s+per\s+day\b|\((?:rpd|tpd)\)", re.IGNORECASE)
_REST = re.compile(r"try again in\s+((?:\d+h)?(?:\d+m(?!s))?(?:[\d.]+s)?(?:\d+ms)?)", re.IGNORECASE)
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


class Refused(Exception):
    """A call answered with an error status. ``quotas`` are the ids of the quotas it broke, where it names them."""

    def __init__(self, status: int, message: str = "", quotas: Sequence[str] = ()) -> None:
        super().__init__(f"{status} {message}".strip())
        self.status, self.message, self.quotas = status, message, tuple(quotas)


class TooLarge(Exception):
    """The request is larger than a provider takes: another provider would only be sent the same, so it is the
    caller's to make it smaller."""


class Exhausted(Exception):
    """Every key rests."""


def of_the_day(e: BaseException) -> bool:
    """A refusal for the day: by a quota whose id names the day, or by a message that names the unit. A limit per
    minute is none."""
    if not isinstance(e, Refused) or e.status != 429:
        return False
    return any("day" in q.lower() for q in e.quotas) or bool(_DAY.search(e.message))


def passes(e: BaseException) -> bool:
    """Worth another try with the same key: limits per minute, errors of the server, nothing came back."""
    if isinstance(e, Refused):
        return e.status >= 500 or e.status == 429 and not of_the_day(e)
    return isinstance(e, OSError)


def rest_of(message: str) -> float:
    """Seconds that the message asks to wait; DEFAULT_REST where it names none."""
    hint = _REST.search(message)
    parts = re.findall(r"([\d.]+)(ms|h|m|s)", hint[1].lower()) if hint else []
    return sum(float(n) * _UNITS[u] for n, u in parts) if parts else DEFAULT_REST


@dataclass
class Keys:
    """Keys of one provider in turn. A key refused for the day rests, ``rolling`` as long as the message says, else
    for good, and the call goes to the next one at once. Threads may share it: the lock is not held during calls."""

    ask: Ask
    keys: Sequence[str]
    rolling: bool = True
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _until: dict[int, float] = field(default_factory=dict)
    _at: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _next(self) -> int:
        with self._lock:
            now = self.clock()
            for step in range(len(self.keys)):
                i = (self._at + step) % len(self.keys)
                if self._until.get(i, 0.0) <= now:
                    self._at = i
                    return i
        raise Exhausted(f"all {len(self.keys)} keys rest" if self.keys else "no keys are given")

    def __call__(self, prompt: str) -> str:
        while True:
            i = self._next()
            try:
                return self._patiently(self.keys[i], prompt)
            except Refused as e:
                if e.status == 413:
                    raise TooLarge(str(e)) from e
                if not of_the_day(e):
                    raise
                with self._lock:
                    self._until[i] = self.clock() + rest_of(e.message) if self.rolling else float("inf")

    def _patiently(self, key: str, prompt: str) -> str:
        wait = FIRST_WAIT
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                return self.ask(key, prompt)
            except Exception as e:
                if not left or not passes(e):
                    raise
            self.sleep(min(wait, LONGEST_WAIT))
            wait *= 2
        raise AssertionError("unreachable")


def in_turn(providers: Sequence[tuple[str, Callable[[str], str]]], valid: Callable[[str], object] | None = None) -> Callable[[str], tuple[str, str]]:
    """``prompt -> (answer, provider's name)``: the first provider that answers and whose answer ``valid`` takes (it raises
    ``ValueError`` otherwise). A request that is too large goes to no other provider; the last failure is raised."""

    def run(prompt: str) -> tuple[str, str]:
        failure: Exception = Exhausted("no provider is given")
        for name, provider in providers:
            try:
                answer = provider(prompt)
                if valid is not None:
                    valid(answer)
                return answer, name
            except TooLarge:
                raise
            except (Refused, Exhausted, OSError, ValueError) as e:
                failure = e
        raise failure

    return run


def in_halves(items: list, ask: Callable[[list], object]) -> tuple[list[tuple[list, object]], list[tuple[list, str]]]:
    """(answers by part, failures by part) of a batch: a part that is too large is asked again in two halves, the first
    before the rest; one item that is too large, or any other failure, is a failed part and the rest goes on."""
    queue, answers, failures = [items] if items else [], [], []
    while queue:
        part = queue.pop(0)
        try:
            answers.append((part, ask(part)))
        except TooLarge as e:
            if len(part) == 1:
                failures.append((part, str(e)))
            else:
                queue[:0] = [part[: len(part) // 2], part[len(part) // 2 :]]
        except (Refused, Exhausted, OSError, ValueError) as e:
            failures.append((part, str(e) or type(e).__name__))
    return answers, failures
