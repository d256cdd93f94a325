"""Polite JSON requests: retries with growing pauses, spacing, a bound on requests at once and a circuit breaker."""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from email.utils import parsedate_to_datetime

#: Answers that are worth another try; those from SERVER on count against the server.
RETRIED = (429, 500, 502, 503, 504)
SERVER = 500


class CircuitOpen(ConnectionError):
    """The server failed so often in a row that it is left alone for a while."""


class Gate:
    """What all requests of a process to one server share: `concurrency` at once at most, `spacing` seconds between their starts, and a breaker that
    refuses requests for `cooldown` seconds after `threshold` server failures in a row (0: never). Pickles as its settings."""

    def __init__(self, concurrency: int = 5, spacing: float = 0.5, threshold: int = 5, cooldown: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.settings = (concurrency, spacing, threshold, cooldown)
        self.spacing, self.threshold, self.cooldown, self.clock, self.sleep = spacing, threshold, cooldown, clock, sleep
        self.slots, self.lock = threading.BoundedSemaphore(concurrency), threading.Lock()
        self.next, self.failures, self.closed_until = float("-inf"), 0, float("-inf")

    def __reduce__(self):
        return Gate, self.settings

    def check(self, url: str) -> None:
        if self.threshold and self.clock() < self.closed_until:
            raise CircuitOpen(f"{url}: {self.failures} failures in a row")

    def __enter__(self) -> None:
        self.slots.acquire()
        with self.lock:
            now = self.clock()
            wait, self.next = self.next - now, max(now, self.next) + self.spacing
        if wait > 0:
            self.sleep(wait)

    def __exit__(self, *_) -> None:
        self.slots.release()

    def succeeded(self) -> None:
        with self.lock:
            self.failures, self.closed_until = 0, float("-inf")

    def failed(self) -> None:
        with self.lock:
            self.failures += 1
            if self.threshold and self.failures >= self.threshold:
                self.closed_until = self.clock() + self.cooldown


_gates: dict[tuple, Gate] = {}


def gate_of(url: str, **settings) -> Gate:
    """The gate that this process keeps for a server under these settings."""
    key = (urllib.parse.urlsplit(url).netloc, *sorted(settings.items()))
    return _gates.setdefault(key, Gate(**settings))


def _asked_pause(header: str | None) -> float | None:
    """Seconds that Retry-After asks for: a number, or until a date."""
    try:
        return max(0.0, float(header))
    except (TypeError, ValueError):
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - time.time())
    except (TypeError, ValueError):
        return None


def ask(url: str, body: dict | None = None, tries: int = 5, base: float = 0.5, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, gate: Gate | None = None) -> dict:
    """The JSON answer to a POST of body, or to a GET without one; retries busy and failing servers with growing pauses (plus or minus a quarter), or the pause
    that Retry-After asks for if there is one. Behind a gate a run of failures ends the tries."""
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json"})
    gate = gate or Gate(concurrency=1, spacing=0.0, threshold=0)
    for i in range(tries):
        gate.check(url)
        pause = base * 2**i * random.uniform(0.75, 1.25)
        try:
            with gate, opener(request, timeout=60) as answer:
                out = json.load(answer)
            gate.succeeded()
            return out
        except urllib.error.HTTPError as e:
            if e.code >= SERVER:
                gate.failed()
            if e.code not in RETRIED or i == tries - 1:
                raise
            asked = _asked_pause(e.headers.get("Retry-After"))
            pause = pause if asked is None else asked
        except urllib.error.URLError:
            gate.failed()
            if i == tries - 1:
                raise
        gate.check(url)
        sleep(pause)
    raise AssertionError


def post(url: str, body: dict, **options) -> dict:
    return ask(url, body, **options)
