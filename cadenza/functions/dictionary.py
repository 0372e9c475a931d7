"""Replacing by a dictionary, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}/-])")


def alternation(keys: list[str]) -> str:
    """A pattern of the keys, the longest first; of equal lengths the first given."""
    return "|".join(_SPECIAL.sub(r"\\\1", k) for k in sorted(dict.fromkeys(keys), key=lambda k: -len(k)))


def replaced(text: Column, values: dict[str, str]) -> Column:
    """Every key in one pass, the longest at each place; what was put in is not looked at again."""
    values = {k: v for k, v in values.items() if k}
    if not values:
        return text
    pattern = alternation(list(values))
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.element_at(table, h))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")


def replaced_in_turn(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Rule after rule, each over the result of the one before."""
    for key, value in rules:
        if key:
            text = F.replace(text, F.lit(key), F.lit(value))
    return text


def relaxed_json(raw: Column, schema: str) -> Column:
    """Strict JSON; where that fails, JSON after // comments are removed, missing commas between lines put in and trailing ones dropped."""
    clean = F.regexp_replace(raw, "(?m)//.*$", "")
    clean = F.regexp_replace(clean, r'(["}\]0-9el])(?=\s*\r?\n\s*["{\[])', "$1,")
    clean = F.regexp_replace(clean, r",(\s*[}\]])", "$1")
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))
    return F.coalesce(valid(raw), valid(clean))
