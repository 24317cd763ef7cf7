"""The seam to a language model: what a client is, retries, a rule-based stand-in."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import partial
from typing import Any, Protocol

# --- fixed values -----------------------------------------------------------
ATTEMPTS = 4
RETRY_STATUS = (429, 500, 502, 503, 504)
# -----------------------------------------------------------------------------

EXTRACT_PROMPT = """Read one fragment of a technical document and answer with a single JSON object:
{"materials": [{"name", "name_en"}], "processes": [{"name", "name_en"}], "equipment": [{"name", "name_en"}],
 "facilities": [{"name", "name_en", "country"}],
 "measurements": [{"property", "value", "value_max", "unit",
                   "conditions": [{"parameter", "op", "value", "value_max", "unit"}]}],
 "conclusions": [{"text", "materials", "processes", "geography", "confidence"}],
 "topics": [], "authors": []}
Use canonical names. Copy numbers exactly as written and never invent any. Leave a list empty when the
fragment says nothing. Name authors only from a title block."""

PARSE_PROMPT = """Turn a question about a document collection into JSON search filters:
{"query", "year_from", "year_to", "language", "category", "geography",
 "constraints": [{"property", "op", "value", "value_max", "unit"}]}
Set only what the question states, null otherwise. Count relative periods from the year {year}."""

ANSWER_PROMPT = """Answer the question from the numbered fragments only. Support every statement with its
[n]. Keep numbers and units as written, show where sources disagree, tell domestic from foreign practice,
and say so when the fragments do not suffice. Begin with a short conclusion and end with open points."""

FRAGMENT_TEMPLATE = "From «{title}», {category}{year}, {unit_kind} {unit_no}, the passage reads:\n\n{text}"


class ModelError(RuntimeError):
    """A call failed; `status` is the service's answer code, None for network trouble."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Client(Protocol):
    model: str

    def complete_text(self, system: str, user: str, max_tokens: int = 2048) -> str: ...


def passing(error: Exception) -> bool:
    """Whether the same call may succeed later: overload, server and network trouble."""
    return getattr(error, "status", None) in (None, *RETRY_STATUS)


def doubling(times: int = ATTEMPTS) -> Iterator[float]:
    """Pauses of 1, 2, 4 … seconds."""
    return (float(1 << k) for k in range(times))


def persistently(call: Callable[[], str], pauses: Iterable[float], sleep: Callable[[float], None]) -> str:
    """What `call` returns, tried once for each pause; a lasting error is raised at once."""
    failures: list[Exception] = []
    for pause in pauses:
        try:
            return call()
        except (ModelError, OSError) as error:
            if not passing(error):
                raise
            failures.append(error)
        sleep(pause)
    raise ModelError(f"gave up after {len(failures)} attempts: {failures[-1] if failures else 'none made'}")


class RetryingClient:
    """A client around one `send(system, user, max_tokens)` call of any provider."""

    def __init__(self, model: str, send: Callable[[str, str, int], str], sleep: Callable[[float], None] = time.sleep):
        self.model, self._send, self._sleep = model, send, sleep

    def complete_text(self, system: str, user: str, max_tokens: int = 2048) -> str:
        return persistently(partial(self._send, system, user, max_tokens), doubling(), self._sleep)


class Malformed(ValueError):
    """A model's text without a JSON object."""


def object_in(text: str) -> dict[str, Any]:
    """The JSON object that begins at the first brace; what stands before and after it does not matter."""
    begin = text.find("{")
    if begin < 0:
        raise Malformed("no brace")
    return json.JSONDecoder().raw_decode(text, begin)[0]


def complete_json(client: Client, system: str, user: str, max_tokens: int = 2048) -> dict[str, Any]:
    """An object from the model; an unreadable answer is asked for once more."""
    problem = None
    for reminder in ("", "\n\nAnswer with one valid JSON object only."):
        try:
            return object_in(client.complete_text(system, user + reminder, max_tokens))
        except ValueError as error:
            problem = error
    raise Malformed(f"no JSON in the answer: {problem}")


class RuleClient:
    """Deterministic stand-in for a model: finds listed names and `property = number unit`.

    It exists so that the jobs around a model can run and be tested; it makes
    no claim to understand text.
    """

    model = "rules"

    def __init__(self, names: Mapping[str, Sequence[str]]):
        self.names = {kind: list(values) for kind, values in names.items()}

    def complete_text(self, system: str, user: str, max_tokens: int = 2048) -> str:
        text = user.split("\n\n", 1)[-1]
        folded = text.casefold()
        found: dict[str, Any] = {
            kind: [{"name": n} for n in values if n.casefold() in folded] for kind, values in self.names.items()
        }
        found["measurements"] = [
            {"property": m[1].strip(), "value": m[2], "unit": m[3]}
            for m in re.finditer(r"(\w[\w ]*?) = ([-+]?\d+(?:[.,]\d+)?) ?([^\s.;,]*)", text)
        ]
        return json.dumps(found, ensure_ascii=False)
