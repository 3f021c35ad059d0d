"""Reverse geocoders behind one protocol, with retries; a deterministic one for tests."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol


class TransientError(RuntimeError):
    """Timeouts, unavailable services, broken connections: worth another attempt, after ``after`` seconds at least."""

    def __init__(self, message: str = "", after: float = 0.0) -> None:
        super().__init__(message)
        self.after = after


class Geocoder(Protocol):
    def reverse(self, lat: float, lon: float) -> tuple[str, list[tuple[str, str]]] | str | None:
        """(address, address parts in order), a JSON reply that says both, or None where there is none."""


class FakeGeocoder:
    """An address by the whole degree; nothing on the null island; transient failures on demand."""

    def __init__(self, failures: int = 0) -> None:
        self.failures = failures

    def reverse(self, lat: float, lon: float) -> tuple[str, list[tuple[str, str]]] | None:
        if self.failures:
            self.failures -= 1
            raise TransientError("timed out")
        if int(lat) == 0 and int(lon) == 0:
            return None
        return f"Street {int(lat)}, Town {int(lon)}", [("amenity", f"Cafe {int(lat)}"), ("country", "Nowhere"), ("shop", "")]


def with_retries(call: Callable[[], object], attempts: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; transient errors are tried again after 2, 4, 8, ... times ``wait``, the last is raised, others at once."""
    for k in range(attempts):
        try:
            return call()
        except TransientError as e:
            if k == attempts - 1:
                raise
            wait *= 2
            sleep(max(wait, e.after))
    raise ValueError("attempts must be positive")
