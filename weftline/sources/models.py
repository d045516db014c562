"""Language models over HTTP: functions from a prompt to a reply, for `enrich`.

Each provider is a request to its public API. The key comes from the caller or from the
environment of the machine that asks, which on a cluster is the executor's."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

from weftline.errors import ConfigurationError, ExtractionError

SYSTEM = "You extract structured data from web pages and answer in JSON."


def _chat(base: str, variable: str):
    def request(model: str, key: str, prompt: str) -> tuple[str, dict, dict]:
        body = {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]}
        return f"{base}/chat/completions", {"Authorization": f"Bearer {key}"}, body

    return variable, request, lambda r: r["choices"][0]["message"]["content"]


def _messages():
    def request(model: str, key: str, prompt: str) -> tuple[str, dict, dict]:
        body = {"model": model, "max_tokens": 4096, "temperature": 0, "system": SYSTEM, "messages": [{"role": "user", "content": prompt}]}
        return "https://api.anthropic.com/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, body

    return "ANTHROPIC_API_KEY", request, lambda r: "".join(part.get("text", "") for part in r["content"])


def _generate():
    def request(model: str, key: str, prompt: str) -> tuple[str, dict, dict]:
        body = {"systemInstruction": {"parts": [{"text": SYSTEM}]}, "contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0, "responseMimeType": "application/json"}}
        return f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", {"x-goog-api-key": key}, body

    return "GEMINI_API_KEY", request, lambda r: "".join(part.get("text", "") for part in r["candidates"][0]["content"]["parts"])


PROVIDERS = {
    "anthropic": _messages(),
    "gemini": _generate(),
    "grok": _chat("https://api.x.ai/v1", "XAI_API_KEY"),
    "openai": _chat("https://api.openai.com/v1", "OPENAI_API_KEY"),
}


def posted(url: str, headers: dict, body: dict, timeout: float = 120) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def completer(provider: str, model: str, key: str | None = None, post: Callable[[str, dict, dict], dict] = posted) -> Callable[[str], str]:
    """A function that asks a provider's model. An answer of another shape is an ExtractionError."""
    if provider not in PROVIDERS:
        raise ConfigurationError(f"provider is one of {', '.join(PROVIDERS)}")
    variable, request, reply = PROVIDERS[provider]

    def complete(prompt: str) -> str:
        own = key or os.environ.get(variable)
        if not own:
            raise ConfigurationError(f"give a key or set {variable}")
        found = post(*request(model, own, prompt))
        try:
            return reply(found)
        except (KeyError, IndexError, TypeError) as e:
            raise ExtractionError(f"{provider} gave no text") from e

    return complete
