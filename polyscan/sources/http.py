"""HTTP for the REST and GraphQL sources: authentication, retries, time limits, and a cache that processes share."""

from __future__ import annotations

import base64
import contextlib
import fcntl
import hashlib
import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode, urljoin, urlsplit

import requests

from polyscan.errors import ConfigError, DecodeError, HttpStatusError, RateLimited, RequestTimeout, SourceError

USER_AGENT = "polyscan/0.1"


def secret(name: str) -> str:
    value = os.environ.get(name)
    if value is None:
        raise ConfigError(f"environment variable {name} is not set")
    return value


def credentials(auth: dict[str, Any] | None) -> tuple[dict[str, str], dict[str, str]]:
    """(headers, query parameters). Configurations name environment variables; the values are read where requests are made."""
    auth = auth or {"type": "none"}
    kind = auth["type"]
    if kind == "basic":
        pair = f"{secret(auth['username_env'])}:{secret(auth['password_env'])}".encode()
        return {"Authorization": f"Basic {base64.b64encode(pair).decode()}"}, {}
    if kind == "bearer":
        return {"Authorization": f"Bearer {secret(auth['token_env'])}"}, {}
    if kind == "api_key":
        pair = {auth["name"]: secret(auth["value_env"])}
        return (pair, {}) if auth["in"] == "header" else ({}, pair)
    if kind == "custom_header":
        return {auth["name"]: secret(auth["value_env"])}, {}
    return {}, {}


def join(base: str, path: str) -> str:
    """The base with the path behind it; a prefix in the base stays."""
    return f"{base.rstrip('/')}/{path.lstrip('/')}"


def with_params(url: str, params: dict[str, str]) -> str:
    if not params:
        return url
    return f"{url}{'&' if urlsplit(url).query else '?'}{urlencode(sorted(params.items()))}"


@dataclass
class Answer:
    url: str
    status: int
    headers: dict[str, str]
    body: bytes

    def json(self):
        try:
            return json.loads(self.body)
        except ValueError as e:
            raise DecodeError(f"no JSON from {self.url}: {e}") from e


@dataclass
class HttpCache:
    """Answers on disk by URL and identity: a time to live, a largest number (first in, first out), and one lock a key, so
    that of several readers who want the same URL one fetches. The folder is for the owner only."""

    ttl_seconds: float
    max_entries: int = 1024
    folder: str = field(default_factory=lambda: os.path.join(tempfile.gettempdir(), f"polyscan-http-{os.getuid()}"))

    def get(self, key: str, fetch) -> Answer:
        os.makedirs(self.folder, mode=0o700, exist_ok=True)
        path = os.path.join(self.folder, hashlib.sha256(key.encode()).hexdigest())
        with open(f"{path}.lock", "w") as lock:
            began = time.time()
            fcntl.flock(lock, fcntl.LOCK_EX)
            with contextlib.suppress(OSError, ValueError, KeyError):
                with open(path) as f:
                    x = json.load(f)
                # fresh enough, or fetched by another while this one waited for it
                if time.time() - x["at"] < self.ttl_seconds or x["at"] >= began:
                    return Answer(x["url"], x["status"], x["headers"], base64.b64decode(x["body"]))
            answer = fetch()
            with open(f"{path}.new", "w") as f:
                json.dump({"at": time.time(), "url": answer.url, "status": answer.status, "headers": answer.headers, "body": base64.b64encode(answer.body).decode()}, f)
            os.replace(f"{path}.new", path)
        self._shrink()
        return answer

    def _shrink(self) -> None:
        with contextlib.suppress(OSError):
            found = sorted((e.stat().st_mtime, e.path) for e in os.scandir(self.folder) if "." not in e.name)
            for _, p in found[: max(0, len(found) - self.max_entries)]:
                os.unlink(p)


class Client:
    """Requests of one source."""

    def __init__(self, auth: dict | None, runtime: dict | None):
        runtime = runtime or {}
        self.headers, self.params = credentials(auth)
        self.timeout = runtime["timeout_ms"] / 1000 if runtime.get("timeout_ms") else None
        retry = runtime.get("retry") or {}
        self.attempts, self.backoff = max(1, int(retry.get("max_attempts", 1))), int(retry.get("backoff_ms", 0)) / 1000
        c = runtime.get("cache")
        self.cache = HttpCache(c["ttl_seconds"], c.get("max_entries") or 1024, **({"folder": c["folder"]} if c.get("folder") else {})) if c else None
        self.slots = int(runtime.get("max_concurrency") or 0)
        self.session = requests.Session()

    def get(self, url: str) -> Answer:
        full = with_params(url, self.params)
        if self.cache is None:
            return self.send("GET", full)
        identity = hashlib.sha256(repr(sorted(self.headers.items())).encode()).hexdigest()
        return self.cache.get(f"{identity} {full}", lambda: self.send("GET", full))

    def post(self, url: str, body: Any) -> Answer:
        return self.send("POST", with_params(url, self.params), body)

    @contextlib.contextmanager
    def _slot(self, host: str):
        """One of max_concurrency places for a host on this machine."""
        if not self.slots:
            yield
            return
        folder = os.path.join(tempfile.gettempdir(), f"polyscan-slots-{os.getuid()}")
        os.makedirs(folder, mode=0o700, exist_ok=True)
        name = hashlib.sha256(host.encode()).hexdigest()[:16]
        k = os.getpid() % self.slots
        with open(os.path.join(folder, f"{name}-{k}"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def send(self, method: str, url: str, body: Any = None) -> Answer:
        shown = url.split("?")[0]
        failure: Exception = SourceError("no attempt")
        for attempt in range(self.attempts):
            wait = self.backoff * 2**attempt
            try:
                with self._slot(urlsplit(url).netloc):
                    r = self.session.request(method, url, json=body, headers={"User-Agent": USER_AGENT, "Accept": "application/json", **self.headers}, timeout=self.timeout)
            except requests.Timeout as e:
                failure = RequestTimeout(f"no answer from {shown} in {self.timeout} s")
                failure.__cause__ = e
            except requests.RequestException as e:
                failure = SourceError(f"request to {shown} failed: {type(e).__name__}")
            else:
                if r.status_code < 400:
                    return Answer(r.url, r.status_code, {k.lower(): v for k, v in r.headers.items()}, r.content)
                failure = (RateLimited if r.status_code == 429 else HttpStatusError)(r.status_code, shown)
                if r.status_code != 429 and r.status_code < 500:
                    raise failure
                after = r.headers.get("Retry-After", "")
                wait = int(after) if after.isdigit() else wait
            if attempt + 1 < self.attempts:
                time.sleep(wait)
        raise failure


def next_link(header: str | None, rel: str, base: str) -> str | None:
    """The target of a relation in a Link header (RFC 8288), resolved against the base."""
    for link in requests.utils.parse_header_links(header.rstrip(">").replace(">,<", ">, <")) if header else ():
        if rel in link.get("rel", "").split():
            return urljoin(base, link["url"])
    return None
