"""Token replacement rules over spans of tokens, with up to eight variants of a query.

Rules are compiled on the driver; texts go through an Arrow UDF, because a replacement may span tokens,
carry groups, and multiply."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VARIANTS = 8
#: Values that hold characters of a pattern make a rule complex.
_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}\s]")


@dataclass(frozen=True)
class Rule:
    """``boundary``: the pattern covers whole tokens; ``keep_original``: the text as it was is a variant too."""

    pattern: str
    to: str
    boundary: bool = True
    keep_original: bool = True
    reduces_relevance: bool = False


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def categorize(rules: dict[str, str | dict]) -> tuple[dict[str, str], dict[str, str]]:
    """Word-for-word rules, which a map lookup does, and all others."""
    simple = {a.lower(): b for a, b in rules.items() if isinstance(b, str) and not _SPECIAL.search(a) and not _SPECIAL.search(b)}
    return simple, {a: b for a, b in rules.items() if a.lower() not in simple}


def compile_rules(rules: dict[str, str | dict], inverse: bool = False) -> list[Rule]:
    """Rules in order of application: longer patterns first. A pattern with diacritics has a twin without;
    ``inverse`` adds to -> from where exactly one rule has that ``to``."""
    out: list[Rule] = []
    targets = [r["text"] if isinstance(r, dict) else r for r in rules.values()]
    for pattern, r in rules.items():
        opts = r if isinstance(r, dict) else {"text": r}
        to = opts["text"]
        rest = {"boundary": not opts.get("skip_boundaries", False), "keep_original": not opts.get("skip_diacritic_stripping", False), "reduces_relevance": opts.get("reduce_relevance", False)}
        for p in dict.fromkeys([pattern.lower(), _plain(pattern.lower())]):
            out.append(Rule(p, to.lower(), **rest))
        if inverse and targets.count(to) == 1 and not _SPECIAL.search(to) and not _SPECIAL.search(pattern):
            out.append(Rule(to.lower(), pattern.lower(), **rest))
    return sorted(out, key=lambda r: (-len(r.pattern), r.pattern))


@functools.cache
def _regex(rule: Rule) -> re.Pattern:
    body = re.sub(r"\$(\d)", r"\\\1", rule.pattern)
    return re.compile(rf"(?<!\S)(?:{body})(?!\S)" if rule.boundary else body, re.IGNORECASE)


def replace_all(rules: list[Rule], tokens: list[str]) -> tuple[list[str], list[int]]:
    """Tokens after every rule in turn, and for each the number of the token it came from."""
    text, owners = list(tokens), list(range(len(tokens)))
    for rule in rules:
        pattern = _regex(rule)
        joined = " ".join(text)
        starts, at = [], 0
        for t in text:
            starts.append(at)
            at += len(t) + 1
        new, owner, pos = [], [], 0
        for m in pattern.finditer(joined):
            if m.end() == m.start():
                continue
            first = max(i for i, s in enumerate(starts) if s <= m.start())
            last = max(i for i, s in enumerate(starts) if s < m.end())
            if first < pos:
                continue
            new += text[pos:first]
            owner += owners[pos:first]
            whole = joined[starts[first] : starts[last] + len(text[last])]
            changed = whole[: m.start() - starts[first]] + m.expand(re.sub(r"\$(\d)", r"\\\1", rule.to)) + whole[m.end() - starts[first] :]
            parts = changed.split()
            new += parts
            owner += [owners[first]] * len(parts)
            pos = last + 1
        text, owners = new + text[pos:], owner + owners[pos:]
    return text, owners


def marked_variants(rules: list[Rule], tokens: list[str], most: int = MAX_VARIANTS) -> list[tuple[list[str], bool]]:
    """Distinct token lists that some subset of the rules makes, those of most rules first, the original among them, at
    most ``most``; each with whether a rule that reduces relevance took part."""
    seen: dict[tuple[str, ...], tuple[int, bool]] = {tuple(tokens): (0, False)}
    frontier = [tuple(tokens)]
    for rule in rules:
        for have in list(frontier):
            made = tuple(replace_all([rule], list(have))[0])
            if made not in seen:
                seen[made] = (seen[have][0] + 1, seen[have][1] or rule.reduces_relevance)
                frontier.append(made)
    ordered = sorted(seen, key=lambda v: (-seen[v][0], len(v)))
    kept = ordered[:most] if tuple(tokens) in ordered[:most] else [*ordered[: most - 1], tuple(tokens)]
    return [(list(v), seen[v][1]) for v in kept]


def variants(rules: list[Rule], tokens: list[str], most: int = MAX_VARIANTS) -> list[list[str]]:
    return [v for v, _ in marked_variants(rules, tokens, most)]


def replaced(tokens, rules: list[Rule]) -> Column:
    """Token array after all rules."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else replace_all(rules, list(t))[0])

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def replaced_with_owner(tokens, rules: list[Rule]) -> Column:
    """struct(tokens, owner): token array after all rules, and for each the number of the token it came from."""

    @F.pandas_udf("struct<tokens:array<string>,owner:array<int>>")
    def run(rows: pd.Series) -> pd.DataFrame:
        made = [([], []) if t is None else replace_all(rules, list(t)) for t in rows]
        return pd.DataFrame({"tokens": [m[0] for m in made], "owner": [m[1] for m in made]})

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def replaced_variants(tokens, rules: list[Rule]) -> Column:
    """Array of struct(tokens, reduced): see ``marked_variants``."""

    @F.pandas_udf("array<struct<tokens:array<string>,reduced:boolean>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else [{"tokens": v, "reduced": r} for v, r in marked_variants(rules, list(t))])

    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def query_rules(rules: dict[str, str | dict]) -> list[Rule]:
    """The rules that a query goes through: those that reduce relevance are for indexing only."""
    return compile_rules({k: v for k, v in rules.items() if not (isinstance(v, dict) and v.get("reduce_relevance"))})
