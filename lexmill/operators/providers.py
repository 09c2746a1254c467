"""Model services: what is sent to each, what is read from its answer, and the callable made of both.

A service is a dialect, two plain functions without state: the request of a call and the content of its
answer. Everything else (keys, transport, repeated tries) is the same for all of them, so a new service
is a new entry of DIALECTS. The callables are made on the driver and run on executors.
"""

from __future__ import annotations

import functools
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from lexmill.operators.inference import AI_WORDS, LEVEL_WORDS, Generate, Model, with_retries

# Names of the services' fields, default settings, and models that think aloud unless told not to.
DEFAULTS = {"temperature": 0.0, "top_p": 0.95, "max_output_tokens": 2048, "seed": 42, "json_mode": True}
THINKING = ("qwen3", "qwq", "deepseek-r1")
GEMINI_URL = "https://generativelanguage.googleapis.com/v1beta/models"


@dataclass(frozen=True)
class Request:
    """One call: where it goes, its headers and its JSON body."""

    url: str
    headers: dict[str, str]
    body: dict


def _with(settings: dict) -> dict:
    return {**DEFAULTS, **{k: v for k, v in settings.items() if v is not None}}


def _base(model: Model) -> str:
    if not model.base_url:
        raise ValueError(f"{model.model_alias} has no base_url")
    return model.base_url.rstrip("/")


def _messages(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def gemini_request(model: Model, system: str, user: str, settings: dict, key: str) -> Request:
    if not key:
        raise ValueError(f"{model.model_alias} has no key")
    s = _with(settings)
    config = {"temperature": s["temperature"], "topP": s["top_p"], "maxOutputTokens": s["max_output_tokens"]} | ({"responseMimeType": "application/json"} if s["json_mode"] else {})
    url = f"{(model.base_url or GEMINI_URL).rstrip('/')}/{model.model_id}:generateContent?key={key}"
    return Request(url, {}, {"contents": [{"parts": [{"text": f"{system}\n\n{user}"}]}], "generationConfig": config})


def chat_request(model: Model, system: str, user: str, settings: dict, key: str) -> Request:
    s, base = _with(settings), _base(model)
    body = {"model": model.model_id, "messages": _messages(system, user), "temperature": s["temperature"], "top_p": s["top_p"], "max_tokens": s["max_output_tokens"], "seed": s["seed"]}
    if s["json_mode"]:
        body["response_format"] = {"type": "json_object"}
    return Request(base if base.endswith("/chat/completions") else f"{base}/chat/completions", {"Authorization": f"Bearer {key}"} if key else {}, body)


def ollama_request(model: Model, system: str, user: str, settings: dict, key: str) -> Request:
    s = _with(settings)
    options = {"temperature": s["temperature"], "top_p": s["top_p"], "num_predict": s["max_output_tokens"], "seed": s["seed"]}
    body = {"model": model.model_id, "messages": _messages(system, user), "stream": False, "options": options}
    if model.model_id.lower().startswith(THINKING):
        body["think"] = False
    if s["json_mode"]:
        body["format"] = "json"
    return Request(f"{_base(model).removesuffix('/v1')}/api/chat", {}, body)


def _dig(value, *path):
    """What stands at the end of a path of keys and positions, None where it breaks off."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and len(value) > step else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


@dataclass(frozen=True)
class Dialect:
    request: Callable[[Model, str, str, dict, str], Request]
    content: tuple[str | int, ...]
    usage: dict[str, tuple[str, ...]]


DIALECTS = {
    "gemini": Dialect(gemini_request, ("candidates", 0, "content", "parts", 0, "text"), {"prompt_tokens": ("usageMetadata", "promptTokenCount"), "completion_tokens": ("usageMetadata", "candidatesTokenCount")}),
    "openai": Dialect(chat_request, ("choices", 0, "message", "content"), {"prompt_tokens": ("usage", "prompt_tokens"), "completion_tokens": ("usage", "completion_tokens")}),
    "ollama": Dialect(ollama_request, ("message", "content"), {"prompt_tokens": ("prompt_eval_count",), "completion_tokens": ("eval_count",)}),
}
NAMES = {"gemini": "gemini", "openai": "openai", "openai_compatible": "openai", "openai-compatible": "openai", "ollama": "ollama", "ollama_native": "ollama", "ollama-native": "ollama"}


def read_answer(dialect: Dialect, data: dict) -> tuple[str, dict[str, int]]:
    """Content and token counts of a service's answer; what is missing is '' and 0."""
    used = {k: int(_dig(data, *path) or 0) for k, path in dialect.usage.items()}
    return str(_dig(data, *dialect.content) or ""), used | {"total_tokens": sum(used.values())}


def post(request: Request, timeout: int) -> dict:
    """The service's JSON answer. A fault of the server or of the connection may be tried again; any
    other status is an error."""
    data = json.dumps(request.body).encode("utf-8")
    call = urllib.request.Request(request.url, data, {"Content-Type": "application/json", **request.headers}, method="POST")
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:  # noqa: S310 - the address is the registry's
            return json.loads(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        if e.code >= 500:
            raise ConnectionError(f"status {e.code}") from e
        raise RuntimeError(f"status {e.code}") from e
    except urllib.error.URLError as e:
        raise ConnectionError(str(e.reason)) from e


def _call(model: Model, dialect: Dialect, send: Callable[[Request, int], dict], system: str, user: str, settings: dict) -> str:
    asked = dialect.request(model, system, user, settings, os.environ.get(str(model.extra.get("api_key_env", "")), ""))
    headers, body = model.extra.get("headers") or {}, model.extra.get("body") or {}
    return read_answer(dialect, send(Request(asked.url, asked.headers | headers, asked.body | body), model.timeout_sec))[0]


def rule_reply(system: str, user: str, settings: dict) -> str:
    """The rule model as a service: the same levels and scopes as inference.rule_answer, for the prompt."""
    low = user.lower()
    if not any(w in low for w in AI_WORDS):
        return json.dumps({"deployment_scope": {"status": "absent", "value": ""}, "maturity_level": 0, "maturity_rationale": "none", "confidence": 0.55})
    level, scope = 1, "pilot"
    for n, words, name in LEVEL_WORDS:
        if any(w in low for w in words):
            level, scope = n, name
    return json.dumps({"deployment_scope": {"status": "present", "value": scope}, "maturity_level": level, "maturity_rationale": "rules", "confidence": 0.78})


def build_provider(model: Model, send: Callable[[Request, int], dict] = post) -> Generate:
    """The callable of a registered model; an unknown service is an error here and not at the first
    document. ``send`` does the transport."""
    name = model.provider.strip().lower()
    if name in ("mock", "rules"):
        return rule_reply
    if name not in NAMES:
        raise ValueError(f"unknown service {model.provider}")
    return with_retries(functools.partial(_call, model, DIALECTS[NAMES[name]], send))
