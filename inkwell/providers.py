"""Language models as an opaque function of a request, with errors as values."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# What users are told.
EMPTY_REPLY = "Empty response from model."
HTTP_ERROR = "OpenRouter error {status}: {reason}"


class ProviderError(RuntimeError):
    """What a provider says when it gives no reply."""


class Provider(Protocol):
    """Takes a request's JSON body and returns the reply's text, or raises ProviderError. Must be picklable."""

    def __call__(self, body: str) -> str: ...


class OfflineStub:
    """NOT a model: answers with a digest of the request, so that pipelines can be tried without a network."""

    def __call__(self, body: str) -> str:
        last = json.loads(body)["messages"][-1]["content"]
        return f"[offline stub] {hashlib.sha256(last.encode()).hexdigest()[:16]}"


class HttpProvider:
    """A chat-completions endpoint. The key is read where the call is made, by `key()`."""

    def __init__(self, url: str, key, title: str = "inkwell", timeout: float = 120, attempts: int = 3):
        self.url, self.key, self.title, self.timeout, self.attempts = url, key, title, timeout, attempts

    def __call__(self, body: str) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key()}", "X-Title": self.title}
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body.encode(), headers), timeout=self.timeout) as r:
                    return reply_text(r.status, r.reason, r.read().decode("utf-8", "replace"))
            except urllib.error.HTTPError as e:
                if e.code not in (429, 500, 502, 503, 504) or attempt + 1 == self.attempts:
                    return reply_text(e.code, e.reason, e.read().decode("utf-8", "replace"))
            except urllib.error.URLError as e:
                if attempt + 1 == self.attempts:
                    raise ProviderError(str(e.reason)) from e
            time.sleep(2**attempt)
        raise ProviderError(EMPTY_REPLY)


def _path(value: object, *steps: str | int) -> object:
    for s in steps:
        try:
            value = value[s]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def reply_text(status: int, reason: str, body: str) -> str:
    """The reply's text of a response; an error's own message, or its status, is raised."""
    try:
        data = json.loads(body)
    except ValueError:
        data = {}
    if not 200 <= status < 300:
        raise ProviderError(_path(data, "error", "message") or HTTP_ERROR.format(status=status, reason=reason))
    if not (text := _path(data, "choices", 0, "message", "content")):
        raise ProviderError(EMPTY_REPLY)
    return text


def called(requests: DataFrame, provider: Provider, body: str = "body", at_once: int = 4) -> DataFrame:
    """requests with reply and model_error; a null body is not sent and gives neither.

    Each task has at most `at_once` calls under way, so partitions times that bounds what the provider sees.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("reply", T.StringType()), T.StructField("model_error", T.StringType())])

    def ask(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return provider(text), None
        except Exception as e:  # noqa: BLE001  one call's failure is that row's result
            return None, str(e) or type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                found = list(pool.map(ask, f[body].where(f[body].notna(), None)))
                yield f.assign(reply=pd.Series([r for r, _ in found], f.index, object), model_error=pd.Series([e for _, e in found], f.index, object))

    return requests.mapInPandas(run, schema)
