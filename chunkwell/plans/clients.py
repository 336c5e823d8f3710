"""Clients of language and embedding models: what they must offer, how calls are tried again, and fakes for tests."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol


class LLMClient(Protocol):
    def complete(self, messages: list[dict], temperature: float, schema: dict | None = None) -> str: ...


class EmbeddingClient(Protocol):
    def embed(self, texts: list[str], input_type: str) -> list[list[float]]: ...


class CallError(Exception):
    """A failed call; ``status`` is that of the response, None if there was none."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def passing(self) -> bool:
        """Worth another try: no response, too many requests, or the server's own fault."""
        return self.status is None or self.status == 429 or self.status >= 500


#: Sends a JSON body to an address with headers, and gives the response's status and body.
Send = Callable[[str, dict, dict], tuple[int, bytes]]


def http_send(timeout: float = 60) -> Send:
    def send(url: str, headers: dict, body: dict) -> tuple[int, bytes]:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return response.status, response.read()
        except urllib.error.HTTPError as error:
            return error.code, error.read()
        except OSError as error:
            raise CallError(str(error)) from error

    return send


def call(send: Send, url: str, headers: dict, body: dict, retries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One response as JSON. Passing failures are tried again, each time after twice the wait."""
    for attempt in range(retries + 1):
        if attempt:
            sleep(base * 2 ** (attempt - 1))
        try:
            status, raw = send(url, headers, body)
            if status < 400:
                return json.loads(raw)
            raise CallError(f"status {status}: {raw[:200]!r}", status)
        except CallError as error:
            if not error.passing or attempt == retries:
                raise
    raise AssertionError("not reached")


class HttpEmbeddings:
    """Embeddings over HTTP: ``{input, model, input_type}`` to ``{data: [{embedding, index}]}``."""

    def __init__(self, url: str, key: str, model: str, send: Send | None = None, most: int = 1000, **retry):
        self.url, self.model, self.most, self.retry = url, model, most, retry
        self.send, self.headers = send or http_send(), {"Authorization": f"Bearer {key}"}

    def embed(self, texts: list[str], input_type: str = "document") -> list[list[float]]:
        if not texts:
            return []
        if len(texts) > self.most:
            raise ValueError(f"{len(texts)} texts; {self.most} at most")
        got = call(self.send, self.url, self.headers, {"input": texts, "model": self.model, "input_type": input_type}, **self.retry)["data"]
        out: list[list[float] | None] = [None] * len(texts)
        for item in got:
            if not 0 <= item["index"] < len(texts):
                raise ValueError(f"index {item['index']} of {len(texts)} texts")
            out[item["index"]] = item["embedding"]
        if len(got) != len(texts) or any(v is None for v in out):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return out

    def batch_embed(self, texts: list[str], input_type: str = "document") -> list[list[float]]:
        return [v for i in range(0, len(texts), self.most) for v in self.embed(texts[i : i + self.most], input_type)]


class HttpCompletions:
    """Chat completions over HTTP, with a strict JSON schema if there is one."""

    def __init__(self, url: str, key: str, model: str, send: Send | None = None, **retry):
        self.url, self.model, self.retry = url, model, retry
        self.send, self.headers = send or http_send(), {"Authorization": f"Bearer {key}"}

    def complete(self, messages: list[dict], temperature: float, schema: dict | None = None) -> str:
        body: dict = {"model": self.model, "messages": messages, "temperature": temperature}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "strict": True, "schema": schema}}
        choices = call(self.send, self.url, self.headers, body, **self.retry).get("choices") or []
        if not choices:
            raise ValueError("a response without choices")
        return choices[0]["message"]["content"]
