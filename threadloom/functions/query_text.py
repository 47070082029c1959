"""From what a user types to a boolean search plan: clean-up rules on the driver, and a small parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Fixed values of the clean-up rules: shares and counts, the words that make a query boolean, the characters that such
#: a query keeps, and those that go from any other.
HIGH_SHARE = 0.15
RAREST = 5
OPERATORS = r"\b(AND|OR|NOT|NEAR)\b"
NOT_KEPT = r"""[^a-zA-Z0-9\s"*.\-_'/]"""
DELETED = r'[*^:{}\[\]()"]'


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; with ``prefix`` the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


def phrases(plan: object) -> list[Phrase]:
    """All phrases of a plan, in order."""
    if isinstance(plan, Phrase):
        return [plan]
    parts = (plan.keep, plan.drop) if isinstance(plan, Not) else plan.parts
    return [p for x in parts for p in phrases(x)]


def joined_words(text: str) -> str:
    """Blanks for hyphens and underscores between word characters, outside quotes; matches don't overlap."""
    parts = re.split(r'("[^"]*")', text)
    return "".join(p if i % 2 else re.sub(r"([A-Za-z0-9_])[-_]([A-Za-z0-9_])", r"\1 \2", p) for i, p in enumerate(parts))


def clean(raw: str, share: Callable[[str], float] | None = None) -> str | None:
    """A match expression, or None if there is nothing to look for.

    ``share`` tells which share of the indexed messages holds a word; without it frequent words stay.
    """
    text = raw.strip()
    if not text:
        return None
    text = joined_words(text)
    if text.count('"') % 2:
        text = text.replace('"', "")
    if re.search(OPERATORS, text):
        kept = " ".join(re.sub(NOT_KEPT, "", text).split())
        if kept:
            return kept
    if re.fullmatch(r'"[^"]+"\s*|[A-Za-z0-9_]+\*?\s*', text):
        return text
    words = re.sub(DELETED, "", text).split()
    if len(words) <= 2:
        return None if not words else words[0] if len(words) == 1 else _all_of(words)
    once = list(dict.fromkeys(w.lower() for w in words))
    kept = once if share is None else [w for w in once if share(w) < HIGH_SHARE]
    if not kept:
        kept = sorted(once, key=share)[:RAREST]
    if len(kept) <= 2:
        return kept[0] if len(kept) == 1 else _all_of(kept)
    return " OR ".join(f'"{w}"' for w in kept)


def _all_of(words: list[str]) -> str:
    return " ".join(f'"{w}"' for w in words)


def parse(expression: str | None, tokenise: Callable[[str], list[str]]) -> object | None:
    """The plan of a match expression, or None where it is malformed. NOT binds closest, then AND (also implied), then OR."""
    if not expression:
        return None
    pieces = re.findall(r'"[^"]*"|\(|\)|[^\s"()]+', expression)
    at = 0

    def peek() -> str | None:
        return pieces[at] if at < len(pieces) else None

    def atom():
        nonlocal at
        word = peek()
        if word is None or word in ("AND", "OR", "NOT", "(", ")"):
            raise ValueError(word)
        at += 1
        prefix = False
        if word.startswith('"'):
            body = word[1:-1]
            if peek() == "*":
                at, prefix = at + 1, True
        else:
            prefix = word.endswith("*")
            body = word[:-1] if prefix else word
            if not re.fullmatch(r"\w+", body):
                raise ValueError(word)
        tokens = tuple(tokenise(body))
        if not tokens:
            raise ValueError(word)
        return Phrase(tokens, prefix)

    def negated():
        nonlocal at
        left = atom()
        while peek() == "NOT":
            at += 1
            left = Not(left, atom())
        return left

    def conjunction():
        nonlocal at
        parts = [negated()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                at += 1
            parts.append(negated())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    try:
        parts = [conjunction()]
        while peek() == "OR":
            at += 1
            parts.append(conjunction())
        if at < len(pieces):
            return None
    except ValueError:
        return None
    return parts[0] if len(parts) == 1 else Or(tuple(parts))
