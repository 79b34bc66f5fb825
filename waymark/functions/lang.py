"""Languages: equivalents, fallback ranks and the choice of a label, as small tables and expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIVERSAL = "universal"
EQUIVALENT = {"hr": ("hr", "bs", "sr"), "bs": ("bs", "hr", "sr"), "sr": ("sr", "hr", "bs")}
#: What to show instead, in order. Only widely agreed neighbours; a catalog may pass its own table.
FALLBACK = {
    "zh": ("zh_Hans", "zh_Hant"), "zh_Hans": ("zh", "zh_Hant"), "zh_Hant": ("zh", "zh_Hans"), "zh_TW": ("zh_Hant", "zh"), "zh_CN": ("zh_Hans", "zh"),
    "pt_BR": ("pt",), "pt": ("pt_BR",), "sr_Latn": ("hr", "bs", "sr"), "sr": ("sr_Cyrl", "bs", "hr"), "hr": ("bs", "sr_Latn"), "bs": ("hr", "sr_Latn"),
    "no": ("nb", "nn"), "nb": ("no", "nn", "da"), "nn": ("no", "nb"), "ca": ("es",), "gl": ("es", "pt"), "eu": ("es",), "uk": ("ru",), "be": ("ru",),
    "kk": ("ru",), "de_CH": ("de",), "fr_CA": ("fr",), "en_GB": ("en",), "es_MX": ("es",), "id": ("ms",), "ms": ("id",),
}


def equivalents(code: str) -> tuple[str, ...]:
    return EQUIVALENT.get(code, (code,))


def primary(code: str) -> str:
    return code.replace("-", "_").split("_")[0]


def fallback_ranking(target: str, candidates: list[str], table: dict[str, tuple[str, ...]] = FALLBACK) -> list[str]:
    """The candidates that may stand in for ``target``, best first; never itself."""
    order = [*table.get(target, ()), primary(target), *table.get(primary(target), ())]
    order += [c for c in sorted(candidates) if primary(c) == primary(target)]
    seen = [c for c in dict.fromkeys(order) if c in candidates and c.lower() != target.lower()]
    return seen


def fallback_matrix(languages: list[str], table: dict[str, tuple[str, ...]] = FALLBACK) -> dict[str, list[str]]:
    return {x: fallback_ranking(x, languages, table) for x in languages}


def label_order(target: str | None, table: dict[str, tuple[str, ...]] = FALLBACK) -> list[str]:
    """Keys to try for a label: exact, its fallbacks, the primary language and its fallbacks, universal."""
    if not target:
        return [UNIVERSAL]
    target = target.replace("-", "_")
    return list(dict.fromkeys([target, *table.get(target, ()), primary(target), *table.get(primary(target), ()), UNIVERSAL]))


def closest_label(texts, target: str | None, strict: bool = False) -> Column:
    """struct(language, text) from a map language -> text: the first of ``label_order`` that it has, the case of
    codes not counting; otherwise, unless ``strict``, a sibling of the same primary language. Null without one."""
    m = F.col(texts) if isinstance(texts, str) else texts
    entries = F.map_entries(m)
    order = [target.replace("-", "_")] if strict and target else label_order(target)
    keyed = lambda code: F.get(F.filter(entries, lambda e: F.replace(F.lower(e["key"]), F.lit("-"), F.lit("_")) == code.lower()), F.lit(0))
    tries = [keyed(code) for code in order]
    if target and not strict:
        near = F.array_sort(F.filter(entries, lambda e: F.split(F.replace(F.lower(e["key"]), F.lit("-"), F.lit("_")), "_")[0] == primary(target).lower()))
        tries.insert(-1, F.get(near, F.lit(0)))
    found = F.coalesce(*tries)
    return F.when(found.isNotNull(), F.struct(found["key"].alias("language"), found["value"].alias("text")))


def has_language(texts, target: str) -> Column:
    """Whether a label of the language, or one that counts as the same, or a universal one is there."""
    m = F.col(texts) if isinstance(texts, str) else texts
    keys = F.transform(F.map_keys(m), lambda k: F.split(F.replace(F.lower(k), F.lit("-"), F.lit("_")), "_")[0])
    wanted = [*equivalents(primary(target).lower()), UNIVERSAL]
    return F.arrays_overlap(keys, F.array(*[F.lit(w) for w in wanted]))
