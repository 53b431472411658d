"""JSON over HTTPS, the transport of remote embedders and language models."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from seekspark.errors import SeekError


def post(url: str, headers: dict, body: dict, timeout: float = 60.0) -> tuple[int, dict]:
    """(status, decoded answer); an answer that is no JSON is empty."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            status, said = answer.status, answer.read()
    except urllib.error.HTTPError as error:
        status, said = error.code, error.read()
    try:
        return status, json.loads(said)
    except ValueError:
        return status, {}


def asked(url: str, headers: dict, body: dict) -> dict:
    """The decoded answer; any status but 200 raises."""
    status, said = post(url, headers, body)
    if status != 200:
        raise SeekError(f"{url.split('/')[2]} answered with status {status}", "LLM_FAILED")
    return said
