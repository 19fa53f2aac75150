"""Extension points (UDF-01 to UDF-04) and the driver-side helpers around pluggable models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PolicyGate(Protocol):
    """FLT-08: a predicate over note columns; it is the last filter of a plan."""

    def readable(self, actor: str) -> Column: ...
    def writable(self, actor: str) -> Column: ...


class AuditSink(Protocol):
    """Takes rows (at, actor, action, target, detail)."""

    def write(self, rows: DataFrame) -> None: ...


class KeyProvider(Protocol):
    def key(self, name: str) -> bytes: ...


class IdentityResolver(Protocol):
    def current(self) -> str: ...


class ReplicationTransport(Protocol):
    def send(self, bundle: DataFrame) -> None: ...


class RetentionPolicy(Protocol):
    """A predicate over note columns: what may be purged."""

    def expired(self, now_ms: int) -> Column: ...


class OpenPolicy:
    """Everything may be read and written."""

    def readable(self, actor: str) -> Column:
        return F.lit(True)

    def writable(self, actor: str) -> Column:
        return F.lit(True)


class ScopePolicy:
    """Private rows are their owner's alone; ``owner`` is the column that names it."""

    def __init__(self, owner: str = "owner"):
        self.owner = owner

    def readable(self, actor: str) -> Column:
        return (F.col("scope") != "private") | (F.col(self.owner) == actor)

    writable = readable


@dataclass
class Extensions:
    """What a session is run with; the defaults restrict nothing and send nothing."""

    policy: PolicyGate = field(default_factory=OpenPolicy)
    actor: str = "local"
    audit: AuditSink | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    ask: Callable[[str], str] | None = None

    def filtered(self, notes: DataFrame) -> DataFrame:
        return notes.where(self.policy.readable(self.actor))


def hypothetical_answers(question: str, ask: Callable[[str], str] | None, most: int = 2) -> list[str]:
    """RET-17: up to two plain sentences that a model gives as answers; any failure means none."""
    if ask is None:
        return []
    try:
        said = ask(question)
    except Exception:  # a model that fails only means fewer queries
        return []
    rows = [re.sub(r"^[\s\-*\d.)]+", "", line).strip() for line in (said or "").splitlines()]
    return [r for r in rows if len(r) > 10 and not r.endswith("?")][:most]


def first_json(said: str | None, limits: dict[str, int] | None = None) -> dict | None:
    """STR-26: the first balanced JSON object of a model's answer, reasoning tags out, text fields cut to their limits."""
    text = re.sub(r"(?is)<(think|reasoning)>.*?</\1>", "", said or "")
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            found, _ = decoder.raw_decode(text[at:])
        except ValueError:
            continue
        if isinstance(found, dict):
            return {k: v[: (limits or {}).get(k, len(v))] if isinstance(v, str) else v for k, v in found.items()}
    return None


def glyphs(names: Iterable[str]) -> dict[str, str]:
    """STR-25: the shortest upper-case beginning of each name that no earlier name has."""
    taken: dict[str, str] = {}
    for name in names:
        letters = re.sub(r"[^\w]", "", name).upper() or "X"
        for n in range(1, len(letters) + 1):
            if letters[:n] not in taken:
                taken[letters[:n]] = name
                break
        else:
            k = 2
            while f"{letters}{k}" in taken:
                k += 1
            taken[f"{letters}{k}"] = name
    return {name: glyph for glyph, name in taken.items()}


def as_millis(value: object) -> int | None:
    """JSN-03: an instant from a number, digits or an ISO date; anything else is none."""
    from datetime import UTC, datetime

    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value)
    text = str(value).strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def clamped(value: object, low: int, high: int, default: int) -> int:
    """JSN-03, SRT-07: a whole number within bounds, or the default."""
    try:
        return max(low, min(high, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
