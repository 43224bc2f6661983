"""Chat and embedding endpoints over HTTP, and tolerant reading of what they say. All optional."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from dataclasses import dataclass, field


def parse_json(text: str, default: object = None) -> object:
    """The first that parses of the outermost braces or brackets, a fenced block, and the whole."""
    if not text:
        return default
    fence = "`" * 3
    tries = [re.search(r"\{.*\}|\[.*\]", text, re.S), re.search(rf"{fence}(?:json)?\s*(.*?){fence}", text, re.S)]
    for part in [*(m[m.lastindex or 0] for m in tries if m), text]:
        try:
            return json.loads(part)
        except ValueError:
            pass
    return default


def numbers(text: str) -> list[int]:
    return list(map(int, re.findall(r"\d+", text)))


def post(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 120) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass
class Chat:
    """An endpoint by kind: chat (messages in, choices out), responses (input in, output out) or local (message out)."""

    model: str
    url: str
    kind: str = "chat"
    key: str = ""
    last_usage: dict = field(default_factory=dict)

    def __call__(self, prompt: str, system: str = "", temperature: float = 0.2, max_tokens: int = 1200) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        base = self.url.rstrip("/")
        if self.kind == "local":
            said = post(f"{base}/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}, headers)
            self.last_usage = {"prompt_tokens": said.get("prompt_eval_count", 0), "completion_tokens": said.get("eval_count", 0)}
            return (said.get("message") or {}).get("content", "")
        if self.kind == "responses":
            said = post(f"{base}/responses", {"model": self.model, "input": messages, "max_output_tokens": max_tokens}, headers)
            use = said.get("usage") or {}
            self.last_usage = {"prompt_tokens": use.get("input_tokens", 0), "completion_tokens": use.get("output_tokens", 0)}
            return "".join(c.get("text", "") for o in said.get("output", []) for c in o.get("content", []) or [])
        said = post(f"{base}/chat/completions", {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}, headers)
        self.last_usage = said.get("usage") or {}
        return said["choices"][0]["message"]["content"] or ""


def build(name: str = "auto", url: str = "", model: str = "", kind: str = "chat") -> Chat | None:
    """A chat model by name; none without one, and for auto where no endpoint is set."""
    name = (name or "none").lower()
    if name in ("none", "off", ""):
        return None
    key = os.environ.get("OPENAI_API_KEY", "")
    if name in ("openai", "auto") and (url or os.environ.get("OPENAI_BASE_URL") or key):
        return Chat(model or "default", url or os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1"), kind, key)
    if name in ("local", "ollama"):
        return Chat(model or "default", url or "http://127.0.0.1:11434", "local")
    if name == "auto":
        return None
    raise ValueError(f"unknown chat model: {name}")


def remote_encoder(url: str, model: str, key: str = "", batch: int = 32):
    """An encoder for ``embed``: texts in batches to an embeddings endpoint."""

    def encode(texts: list[str]):
        import numpy as np

        from ..operators.embed import _unit

        rows = []
        for i in range(0, len(texts), batch):
            said = post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts[i : i + batch]}, {"Authorization": f"Bearer {key}"} if key else None)
            rows += [d["embedding"] for d in said["data"]]
        return _unit(np.array(rows, np.float32))

    return encode
