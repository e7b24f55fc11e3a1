"""Literal replacement by environment, ordered swaps and payload encoding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Mapping[str, str]]


def replace_by_environment(text: Column, environment: Column, rules: Sequence[Rule]) -> Column:
    """Apply ``(find, {environment: value})`` rules in order, as literal text.

    Each rule makes one pass and does not look at its own output again; a later
    rule sees what earlier ones wrote. Rows of an environment a rule does not
    name keep their text: a row is searched for what its own environment
    replaces and nothing else.
    """
    replaced: dict[str, Column] = {}
    for find, values in rules:
        if not find:
            raise ValueError("a rule needs text to find")
        for name, value in values.items():
            if value is None:
                raise ValueError(f"no text to put in place of {find!r} in {name!r}")
            if value != find:
                replaced[name] = F.replace(replaced.get(name, text), F.lit(find), F.lit(value))
    result = text
    for name, own in replaced.items():
        result = F.when(environment == F.lit(name), own).otherwise(result)
    return result


def close_pairs(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The one-step map that equals applying (from, to) pairs one after another.

    Working backwards, the end of ``a -> b`` is where the later pairs take ``b``.
    Pairs with an empty ``from`` are skipped.
    """
    closed: dict[str, str] = {}
    for old, new in reversed(list(pairs)):
        if old:
            closed[old] = closed.get(new, new)
    return closed


def base64_payload(text: Column) -> Column:
    """Base64 of the UTF-8 bytes on a single line."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")
