"""Clients over HTTP: models that speak the chat-completions protocol, and reverse geocoders that answer with JSON."""

from __future__ import annotations

import base64
import hashlib
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from email.utils import parsedate_to_datetime

from photonflow.services.geocoder import TransientError, with_retries

#: States that another attempt may mend; other ones from 400 on are final.
TRANSIENT = {408, 425, 429, 500, 502, 503, 504}
KINDS = ((b"\xff\xd8", "image/jpeg"), (b"\x89PNG", "image/png"), (b"RIFF", "image/webp"))


class Refused(RuntimeError):
    """The server understood and said no; its words are the message."""


class Pace:
    """At most ``per_second`` calls of ``wait`` return in a second, whichever threads call; no limit without."""

    def __init__(self, per_second: float | None) -> None:
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            self.next = max(now, self.next) + self.gap
            ahead = self.next - self.gap - now
        if ahead > 0:
            time.sleep(ahead)


def _after(text: str | None) -> float:
    """Seconds that a Retry-After header asks for."""
    try:
        return max(0.0, float(text))
    except (TypeError, ValueError):
        pass
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - time.time())
    except (TypeError, ValueError):
        return 0.0


class Http:
    """Requests to one server, paced, with the classes of errors told apart."""

    def __init__(self, url: str, timeout: float, per_second: float | None, headers: dict[str, str]) -> None:
        self.url, self.timeout, self.headers, self.pace = url.rstrip("/"), timeout, headers, Pace(per_second)

    def request(self, method: str, path: str, body: bytes | None = None, kind: str = "application/json") -> bytes:
        self.pace.wait()
        call = urllib.request.Request(self.url + path, body, self.headers | ({"Content-Type": kind} if body is not None else {}), method=method)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                return reply.read()
        except urllib.error.HTTPError as e:
            said = f"{e.code} {e.read().decode('utf-8', 'replace')[:2000]}".strip()
            if e.code in TRANSIENT:
                raise TransientError(said, _after(e.headers.get("Retry-After"))) from e
            raise Refused(said) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise TransientError(f"{type(e).__name__}: {e}") from e


class HttpModel:
    """A model behind ``POST /v1/chat/completions``.

    Images go inside the request; with ``uploads`` they go once to ``/images/<sha256>`` and requests name them, so that an image that the
    server has, from this or another run, is not sent again. ``per_second`` is the share of this client in the run's rate.
    """

    def __init__(self, url: str, key: str | None = None, timeout: float = 600, attempts: int = 4, wait: float = 0.5, per_second: float | None = None, uploads: bool = False) -> None:
        self.http = Http(url, timeout, per_second, {"Authorization": f"Bearer {key}"} if key else {})
        self.attempts, self.wait, self.uploads, self.model, self.context_length = attempts, wait, uploads, "", None

    def open(self, model: str, context_length: int | None = None) -> None:
        self.model, self.context_length = model, context_length

    def close(self) -> None:
        self.model = ""

    def handle(self, image: bytes) -> str:
        """What a request calls the image by."""
        kind = next((k for magic, k in KINDS if image.startswith(magic)), "application/octet-stream")
        if not self.uploads:
            return f"data:{kind};base64,{base64.b64encode(image).decode()}"
        path = f"/images/{hashlib.sha256(image).hexdigest()}"
        try:
            self._try("HEAD", path)
        except Refused as e:
            if not str(e).startswith("404"):
                raise
            self._try("PUT", path, image, kind)
        return self.http.url + path

    def _try(self, *request: object) -> bytes:
        return with_retries(lambda: self.http.request(*request), self.attempts, self.wait)

    def respond(self, prompt: str, image: bytes | None = None) -> str:
        content = prompt if image is None else [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": self.handle(image)}}]
        body = {"model": self.model, "messages": [{"role": "user", "content": content}]}
        if self.context_length:
            body["context_length"] = self.context_length
        reply = json.loads(self._try("POST", "/v1/chat/completions", json.dumps(body).encode()))
        return reply["choices"][0]["message"]["content"] or ""


class HttpGeocoder:
    """A geocoder behind ``GET /reverse``; its JSON reply is decoded in columns (``geo.decoded_place``). Attempts are the caller's."""

    def __init__(self, url: str, language: str = "en", agent: str = "photonflow", timeout: float = 30, per_second: float | None = 1.0) -> None:
        self.http, self.language = Http(url, timeout, per_second, {"User-Agent": agent}), language

    def reverse(self, lat: float, lon: float) -> str:
        asked = {"lat": repr(lat), "lon": repr(lon), "format": "jsonv2", "zoom": 18, "addressdetails": 1, "accept-language": self.language}
        return self.http.request("GET", "/reverse?" + urllib.parse.urlencode(asked)).decode()
