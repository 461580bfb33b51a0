"""Checks of small JSON documents: exact fields and plain values, nothing coerced."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

HEX40, HEX64 = re.compile(r"[0-9a-f]{40}"), re.compile(r"[0-9a-f]{64}")


class Document:
    """An object of a document; every check that fails raises what ``fail`` makes."""

    def __init__(self, value: object, where: str, fail: Callable[[str], Exception]):
        self.fail, self.where = fail, where
        if not isinstance(value, dict):
            raise fail(f"{where} must be an object")
        self.value = value

    def exactly(self, *fields: str) -> Document:
        have = set(self.value)
        if have != set(fields):
            raise self.fail(f"{self.where}: missing {sorted(set(fields) - have)}, unknown {sorted(have - set(fields))}")
        return self

    def text(self, name: str, pattern: re.Pattern | None = None, *, empty: bool = False) -> str:
        """A text on one line, which the whole pattern matches."""
        value = self.value.get(name)
        if not isinstance(value, str) or (not value and not empty) or any(c in value for c in "\n\r\0"):
            raise self.fail(f"{self.where}.{name} must be a text on one line")
        if pattern is not None and not pattern.fullmatch(value):
            raise self.fail(f"{self.where}.{name} is malformed: {value}")
        return value

    def among(self, name: str, values: Iterable[str]) -> str:
        value = self.value.get(name)
        if value not in set(values):
            raise self.fail(f"{self.where}.{name} is not supported: {value}")
        return value

    def texts(self, name: str, *, some: bool = True) -> list[str]:
        """A list of different texts, without commas, which other formats take as borders."""
        value = self.value.get(name, [] if not some else None)
        if not isinstance(value, list) or (some and not value) or not all(isinstance(x, str) and x and not set(x) & set("\n\r\0,") for x in value):
            raise self.fail(f"{self.where}.{name} must be a list of texts")
        if len(set(value)) != len(value):
            raise self.fail(f"{self.where}.{name} has a text twice")
        return value

    def whole(self, name: str, least: int = 0) -> int:
        value = self.value.get(name)
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise self.fail(f"{self.where}.{name} must be a whole number from {least} on")
        return value

    def flag(self, name: str, default: bool | None = None) -> bool:
        value = self.value.get(name, default)
        if not isinstance(value, bool):
            raise self.fail(f"{self.where}.{name} must be true or false")
        return value

    def inner(self, name: str) -> Document:
        return Document(self.value.get(name), f"{self.where}.{name}", self.fail)

    def relative(self, name: str, *, empty: bool = False) -> str:
        """A path that stays below where it starts."""
        value = self.text(name, empty=empty)
        if value.startswith("/") or ".." in value.split("/"):
            raise self.fail(f"{self.where}.{name} must stay inside")
        return value


def strict_json(text: str) -> object:
    """JSON without duplicate keys, NaN or infinities."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("duplicate key")
        return out

    def no(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=no)


def parsed(text: str | bytes, where: str, fail: Callable[[str], Exception]) -> Document:
    try:
        value = strict_json(text.decode() if isinstance(text, bytes) else text)
    except ValueError as e:
        raise fail(f"{where} is no JSON: {e}") from e
    return Document(value, where, fail)


def canonical_line(value: object) -> bytes:
    """One line of canonical JSON."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()
