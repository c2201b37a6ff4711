"""A translator over HTTP: any service that takes chat messages as JSON and answers with choices."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.operators.chunks import prompt

#: Attempts for one text, and the statuses worth another one.
ATTEMPTS, AGAIN = 4, (408, 409, 425, 429, 500, 502, 503, 504)


@dataclass
class ChatTranslator:
    """Translates one text a call; goes to the workers with a task. The key is read from the named variable there, never stored."""

    endpoint: str
    model: str
    lang: str = "zh-CN"
    key_variable: str = "QUIRE_TRANSLATOR_KEY"
    glossary: dict[str, str] = field(default_factory=dict)
    context: str = ""
    timeout: float = 120.0
    send: Callable | None = None  # (request, timeout) -> bytes, for other transports
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, text: str) -> str:
        body = {"model": self.model, "messages": prompt(text, self.lang, self.glossary, self.context), "temperature": 0.2}
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.endpoint, json.dumps(body, ensure_ascii=False).encode(), headers)
        for n in range(1, ATTEMPTS + 1):
            try:
                answer = json.loads((self.send or _send)(request, self.timeout))
                return answer["choices"][0]["message"]["content"].strip()
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or n == ATTEMPTS:
                    raise
            except (OSError, ValueError, KeyError, IndexError):
                if n == ATTEMPTS:
                    raise
            self.sleep(min(2.0**n, 30.0))
        raise AssertionError("unreachable")


def _send(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        return r.read()
