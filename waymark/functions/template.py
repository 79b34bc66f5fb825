"""Place names from templates: {{layer.name}}, {{layer.number}}, {{layer.properties.key}}, helper calls
{{move_number_to_end layer.name}}, and conditions {{#if layer.name}} ... {{else}} ... {{/if}} and
{{#eq layer.name "text"}} ... {{/eq}}. What isn't there renders empty; stray commas and blanks are tidied."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"\{\{\{?\s*(.+?)\s*\}?\}\}")
_ARG = re.compile(r'"[^"]*"|\'[^\']*\'|\S+')
_TIDY = [(r"\{.+?\}", ""), (r", \s*$", ""), (r" , ", ", "), (r" {2,}", " "), (r", -", ","), (r", ,", ""), (r"^,", ""), (r",,", ",")]

HELPERS: dict[str, Callable[..., str]] = {
    "move_number_to_end": lambda s: re.sub(r"^(\d+) ([^\d]+)$", r"\2 \1", s or ""),
    "uppercase": lambda s: (s or "").upper(),
    "lowercase": lambda s: (s or "").lower(),
}
TESTS: dict[str, Callable[..., bool]] = {
    "if": lambda a: bool(a), "unless": lambda a: not a, "eq": lambda a, b: a == b, "isnt": lambda a, b: a != b,
    "gt": lambda a, b: float(a or 0) > float(b or 0), "lt": lambda a, b: float(a or 0) < float(b or 0),
    "and": lambda a, b: bool(a) and bool(b), "or": lambda a, b: bool(a) or bool(b), "startsWith": lambda a, b: (b or "").startswith(a or ""),
}


def _parse(template: str) -> list:
    """Nested lists: text, ('value', args), ('block', name, args, then, otherwise)."""
    root: list = []
    stack: list = [(root, None)]
    at = 0
    for m in _TAG.finditer(template):
        stack[-1][0].append(template[at : m.start()])
        at, body = m.end(), m[1]
        if body.startswith("#"):
            name, *args = _ARG.findall(body[1:])
            block = ("block", name, args, [], [])
            stack[-1][0].append(block)
            stack.append((block[3], block))
        elif body == "else" and stack[-1][1]:
            block = stack.pop()[1]
            stack.append((block[4], block))
        elif body.startswith("/"):
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1][0].append(("value", _ARG.findall(body)))
    stack[-1][0].append(template[at:])
    return root


def _value(arg: str, values: dict):
    if arg[0] in "\"'":
        return arg[1:-1]
    here = values
    for part in arg.split("."):
        here = here.get(part) if isinstance(here, dict) else None
    return here


def _render(nodes: list, values: dict, helpers: dict) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
        elif n[0] == "value":
            name, *args = n[1]
            got = helpers[name](*[_value(a, values) for a in args]) if name in helpers and args else _value(name, values)
            out.append("" if got is None or isinstance(got, dict) else str(got))
        else:
            test = TESTS.get(n[1])
            holds = test is not None and test(*[_value(a, values) for a in n[2]])
            out.append(_render(n[3] if holds else n[4], values, helpers))
    return "".join(out)


def render(template: str, values: dict, helpers: dict | None = None) -> str:
    text = _render(_parse(template), values, HELPERS | (helpers or {}))
    for pattern, to in _TIDY:
        text = re.sub(pattern, to, text)
    return text.strip().removesuffix(",")


def formatted(context, template, helpers: dict | None = None) -> Column:
    """Place name of a context: array of struct(type, name, number); template: a string or a column of them. Without a
    template the names, the first with its number, joined by commas."""
    c = F.col(context) if isinstance(context, str) else context
    t = F.lit(template) if isinstance(template, str) or template is None else template

    @F.pandas_udf("string")
    def run(rows: pd.Series, templates: pd.Series) -> pd.Series:
        def one(row, form):
            items = [dict(r) if isinstance(r, dict) else r.asDict() for r in row] if row is not None else []
            if not form:
                lead = f"{items[0]['number']} " if items and items[0].get("number") else ""
                return (lead + ", ".join(i["name"] for i in items if i["name"])).strip()
            values = {}
            for i in items:
                values.setdefault(i["type"], {"name": i["name"], "number": (i.get("number") or "").split(",")[0]})
            return render(form, values, helpers)

        return pd.Series([one(r, f) for r, f in zip(rows, templates)])

    return run(F.transform(c, lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), x["number"].cast("string").alias("number"))), t.cast("string"))


def format_choice(formats, language: str | None) -> Column:
    """The template for a language from a map, else the one under the empty key."""
    m = F.col(formats) if isinstance(formats, str) else formats
    own = F.try_element_at(m, F.lit(language)) if language else F.lit(None).cast("string")
    return F.coalesce(own, F.try_element_at(m, F.lit("")))
