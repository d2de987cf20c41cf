"""Calls of a model behind a replaceable transport: messages, retries, bounded concurrency."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from ..config import EngineConfig
from ..functions import text as X

_TAGGED = re.compile(X.TAGGED)


class Transport(Protocol):
    """Sends one request and returns {'content': text} and, for structured calls, {'parsed': JSON or a dict}."""

    def __call__(self, request: dict) -> dict: ...


def python_transcription(reply: str) -> str:
    """extract_transcription for one text."""
    found = _TAGGED.search(reply)
    return (found[1] if found else reply).strip()


def messages(b64: str, mime: str, system_prompt: str | None = None, user_prompt: str | None = None, schema=None) -> list[dict]:
    if schema is not None and not system_prompt:
        raise ValueError("a structured call needs a system prompt of its own")
    system = system_prompt if schema is not None else f"{system_prompt}\n\n{X.TAG_PROMPT}" if system_prompt else X.SYSTEM_PROMPT
    image = {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{b64}"}}
    return [{"role": "system", "content": system}, {"role": "user", "content": [image, {"type": "text", "text": user_prompt or X.USER_PROMPT}]}]


class Client:
    """Tries again after growing waits, and raises RuntimeError after the last attempt."""

    def __init__(self, transport: Transport, config: EngineConfig, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.config, self.sleep = transport, config, sleep

    def invoke(self, b64: str, mime: str, system_prompt: str | None = None, user_prompt: str | None = None, schema=None, temperature: float | None = None) -> dict | None:
        c = self.config
        request = {"model": c.model_name, "messages": messages(b64, mime, system_prompt, user_prompt, schema), "max_tokens": c.max_tokens, "temperature": temperature or c.temperature, "schema": schema}
        for attempt in range(c.max_retries):
            try:
                return self.transport(request)
            except Exception as failure:
                if attempt == c.max_retries - 1:
                    raise RuntimeError(f"the model call failed {c.max_retries} times: {failure}") from failure
                self.sleep(c.retry_delay * (attempt + 1))
        return None


class HttpTransport:
    """A chat-completions endpoint over HTTP."""

    def __init__(self, config: EngineConfig):
        self.url, self.key, self.timeout = f"{config.base_url.rstrip('/')}/chat/completions", config.api_key, config.timeout

    def __call__(self, request: dict) -> dict:
        body = {k: v for k, v in request.items() if k != "schema"}
        if request["schema"] is not None:
            body["response_format"] = {"type": "json_object"} if isinstance(request["schema"], str) else {"type": "json_schema", "json_schema": request["schema"]}
        sent = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(sent, timeout=self.timeout) as got:
            choices = json.load(got).get("choices") or []
        content = choices[0]["message"].get("content") if choices else None
        return {"content": content, "parsed": content if request["schema"] is not None else None}


def bounded(work: Callable, items: list, most: int) -> list:
    """work of all items in order, at most so many at a time."""
    if most <= 1 or len(items) <= 1:
        return [work(i) for i in items]
    with ThreadPoolExecutor(min(most, len(items))) as pool:
        return list(pool.map(work, items))
