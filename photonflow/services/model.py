"""Language models behind one protocol; a deterministic one for tests and dry runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol


class ModelClient(Protocol):
    """Opened and closed once for each partition."""

    def open(self, model: str, context_length: int | None = None) -> None: ...

    def respond(self, prompt: str, image: bytes | None = None) -> str: ...

    def close(self) -> None: ...


class FakeModel:
    """Answers with a digest of what it is asked; prompts that contain ``fail_on`` raise."""

    def __init__(self, fail_on: str | None = None) -> None:
        self.fail_on, self.model = fail_on, ""

    def open(self, model: str, context_length: int | None = None) -> None:
        self.model = model

    def respond(self, prompt: str, image: bytes | None = None) -> str:
        if self.fail_on and self.fail_on in prompt:
            raise RuntimeError("model refused")
        return "reply " + hashlib.sha256(self.model.encode() + prompt.encode() + (image or b"")).hexdigest()[:16]

    def close(self) -> None:
        self.model = ""


BACKENDS: dict[str, Callable[[], ModelClient]] = {"fake": FakeModel}


def register_backend(name: str, factory: Callable[[], ModelClient]) -> None:
    BACKENDS[name] = factory


def backend(name: str) -> Callable[[], ModelClient]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]
