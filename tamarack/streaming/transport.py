"""Chat services behind a labeller: retries, answers that are no chat answer, settings, a list of providers.

Nothing here opens a connection: ``send(payload)`` is injected and gives
(status, headers, body text), or raises OSError if the service is not reached.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from tamarack.sources.paged import Throttle, wait_seconds

#: Seconds by which waiting grows: for a service that is busy, and for one that fails or is not reached.
BUSY_STEP, FAILED_STEP = 5.0, 3.0
#: Characters of a malformed answer that are shown.
SHOWN = 300


class TransportError(RuntimeError):
    """The service gave no answer."""


@dataclass(frozen=True)
class Settings:
    """How answers are generated: the same ones for the same text, as JSON."""

    model: str
    temperature: float = 0.0
    response_format: str = "json_object"

    def payload(self, messages: list[dict]) -> dict:
        return asdict(self) | {"response_format": {"type": self.response_format}, "messages": messages}


def sent(send: Callable[[dict], tuple[int, dict, str]], payload: dict, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """Body of an answer of status 200. Busy (429: as long as it asks for), failing (5xx) and unreachable services are
    asked again, ``attempts`` times in all; any other status is an error at once."""
    said = "not asked"
    for k in range(attempts):
        try:
            status, headers, body = send(payload)
        except OSError as e:
            said, wait = str(e), FAILED_STEP * (k + 1)
        else:
            if status == 200:
                return body
            said = f"status {status}"
            if status != 429 and status < 500:
                raise TransportError(said)
            asked = next((v for n, v in headers.items() if n.lower() == "retry-after"), None)
            wait = wait_seconds(status, asked, k, BUSY_STEP if status == 429 else FAILED_STEP)
        if k < attempts - 1:
            sleep(wait)
    raise TransportError(f"{said} after {attempts} attempts")


def content_of(body: str) -> str:
    """The message of a chat answer. One that is no such answer comes as an object of a field no posting has, so that it
    is refused like any wrong answer and asked again."""
    try:
        content = json.loads(body)["choices"][0]["message"]["content"]
        if isinstance(content, str):
            return content
    except (ValueError, LookupError, TypeError):
        pass
    return json.dumps({"malformed_answer": body[:SHOWN]}, ensure_ascii=False)


@dataclass(frozen=True)
class Service:
    """Factory of ``chat`` for a task: one connection, one rate. ``connect()`` gives the task's ``send``."""

    connect: Callable[[], Callable[[dict], tuple[int, dict, str]]]
    settings: Settings
    interval: float = 1.0
    attempts: int = 5

    def __call__(self) -> Callable[[list[dict]], str]:
        send, throttle = self.connect(), Throttle(self.interval)

        def once(payload: dict) -> tuple[int, dict, str]:
            throttle.wait()
            return send(payload)

        return lambda messages: content_of(sent(once, self.settings.payload(messages), self.attempts))


@dataclass(frozen=True)
class Provider:
    """A service by name. Inactive ones own no postings and only run to mop up."""

    name: str
    labeller: str
    factory: Callable[[], Callable[[list[dict]], str]]
    active: bool = True
