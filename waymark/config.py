"""Sources (layers) and query options."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """One layer. ``idx`` orders layers from coarse to fine and is given by ``catalog``; layers of one logical name
    (``family``, else ``name``) share an ``ndx`` and are never stacked with each other.

    ``tokens``: replacement rules (see ``functions.rewrite``), or a function that gives them, for indexing and queries alike. ``patterns``:
    regexes replaced in whole texts and queries before that. ``formats``: language -> template of
    place names, the default under "". ``languages``: those of its texts; a feature that lacks one is found by its nearest.
    ``autopopulate``: stack -> languages that untranslated texts count for. ``categories``: synonyms that hold in every language.
    ``number_order``: "first" or "last", where house numbers are expected. ``bounds`` limit what a point query or a box can reach."""

    name: str
    family: str | None = None
    zoom: int = 6
    type: str | None = None
    types: tuple[str, ...] = ()
    stack: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    worldview: str | None = None
    maxscore: float | None = None
    minscore: float = 0.0
    scoreranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)
    is_address: bool = False
    number_order: str | None = None
    intersection_token: str | None = None
    inherit_score: bool = False
    grant_score: bool = True
    ignore_order: bool = False
    address_order: str = "ascending"
    coalesce_radius: float | None = None
    reverse_by_score: bool = True
    tokens: dict[str, str | dict] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    frequent_words: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    autopopulate: dict[str, tuple[str, ...]] = field(default_factory=dict)
    universal_text: bool = False
    formats: dict[str, str] = field(default_factory=dict)

    @property
    def all_types(self) -> tuple[str, ...]:
        return self.types or (self.type or self.name,)

    @property
    def subtypes(self) -> tuple[str, ...]:
        return tuple(f"{t}.{s}" for t in self.all_types for s in self.scoreranges)

    def allows(self, types: list[str] | None = None, stacks: list[str] | None = None, worldview: str | None = None) -> bool:
        """Whether any of its features may answer: decided before anything is read."""
        by_type = not types or bool(set(types) & {*self.all_types, *self.subtypes})
        by_stack = not stacks or not self.stack or bool(set(stacks) & set(self.stack))
        return by_type and by_stack and (self.worldview is None or worldview is None or self.worldview == worldview)


def max_score(sources: list[Source]) -> float:
    """Largest score over all sources; 1 if any of them doesn't state one."""
    scores = [s.maxscore for s in sources]
    return 1.0 if not scores or None in scores else max(scores)


def min_score(sources: list[Source]) -> float:
    """Always 0: a stated minimum has never had an effect on results."""
    return 0.0


def catalog(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The dimension table of sources, one small row each; ``config`` holds a source whole."""
    ndx: dict[str, int] = {}
    rows = []
    sources = [replace(s, tokens=s.tokens()) if callable(s.tokens) else s for s in sources]
    for idx, s in enumerate(sources):
        apart = [j for j, o in enumerate(sources) if s.stack and o.stack and not set(s.stack) & set(o.stack)]
        rows.append(
            (
                s.name, idx, ndx.setdefault(s.family or s.name, len(ndx)), s.zoom, list(s.all_types), list(s.stack), float(s.maxscore or 1.0), list(map(float, s.bounds)), s.is_address, s.inherit_score, s.grant_score,
                s.ignore_order, s.address_order, s.number_order, s.coalesce_radius, s.worldview, {k: list(map(float, v)) for k, v in s.scoreranges.items()}, apart, json.dumps(asdict(s)),
            )
        )
    return spark.createDataFrame(
        rows,
        "source string, idx int, ndx int, zoom int, types array<string>, stack array<string>, maxscore double, bounds array<double>, is_address boolean, inherit_score boolean, "
        "grant_score boolean, ignore_order boolean, address_order string, number_order string, radius double, worldview string, scoreranges map<string,array<double>>, apart array<int>, config string",
    )


def layers_of(catalog: DataFrame) -> list[Source]:
    """The sources of a catalog, in order."""
    rows = catalog.select("idx", "config").collect()  # a row per layer
    return [_source(json.loads(r.config)) for r in sorted(rows, key=lambda r: r.idx)]


def _source(stored: dict) -> Source:
    tuples = {f.name for f in fields(Source) if str(f.type).startswith("tuple")}
    made = {k: tuple(v) if k in tuples else v for k, v in stored.items()}
    return Source(**made | {k: {x: tuple(v) for x, v in made[k].items()} for k in ("scoreranges", "autopopulate")})


def worldviews(sources: list[Source]) -> list[str]:
    return list(dict.fromkeys(s.worldview for s in sources if s.worldview))


class InvalidOption(ValueError):
    code = "EINVALID"


@dataclass(frozen=True)
class Options:
    """``limit``: 5 and at most 10 in forward queries; in reverse ones 1, and up to 5 with exactly one type.
    ``language``: codes of the result's texts, the first one also for matching; ``language_mode`` "strict": only features
    with a text in one of them. ``worldview``: without one the first that the sources name. ``routing``: adds points to route to."""

    types: list[str] | None = None
    stacks: list[str] | None = None
    proximity: tuple[float, float] | None = None
    bbox: tuple[float, float, float, float] | None = None
    language: list[str] | None = None
    language_mode: str | None = None
    limit: int | None = None
    autocomplete: bool = True
    fuzzy: bool = True
    worldview: str | None = None
    reverse_mode: str = "distance"
    routing: bool = False
    allow_dupes: bool = False

    def checked(self, sources: list[Source], reverse: bool = False) -> Options:
        """The same options, normalised; raises InvalidOption."""
        known = {t for s in sources for t in (*s.all_types, *s.subtypes)}
        types, limit = self.types, self.limit
        if self.types is not None:
            if not self.types or set(self.types) - known:
                raise InvalidOption(f"types must be some of {sorted(known)}, not {self.types}")
            # a subtype is covered by its type
            types = sorted(t for t in set(self.types) if "." not in t or t.split(".")[0] not in self.types)
        stacks = self.stacks and [x.lower() for x in self.stacks]
        if self.stacks is not None and (not stacks or (bad := set(stacks) - {x for s in sources for x in s.stack})):
            raise InvalidOption(f"unknown stacks {sorted(bad) if stacks else stacks}")
        if self.proximity is not None and not (len(self.proximity) == 2 and abs(self.proximity[0]) <= 180 and abs(self.proximity[1]) <= 90):
            raise InvalidOption("proximity must be (lon, lat)")
        if self.bbox is not None and not (len(self.bbox) == 4 and all(abs(v) <= 180 for v in self.bbox[::2]) and all(abs(v) <= 90 for v in self.bbox[1::2]) and self.bbox[1] <= self.bbox[3]):
            raise InvalidOption("bbox must be (west, south, east, north)")
        if self.language is not None and (len(self.language) > 20 or len(set(self.language)) != len(self.language)):
            raise InvalidOption("language must be at most 20 different codes")
        if self.language is not None and (bad := [c for c in self.language if not re.fullmatch(r"[A-Za-z]{2,8}([-_][A-Za-z0-9]{1,8})*", c)]):
            raise InvalidOption(f"no language codes: {bad}")
        views = worldviews(sources)
        if self.worldview is not None and self.worldview not in views:
            raise InvalidOption(f"worldview must be one of {views}")
        if self.language_mode not in (None, "strict"):
            raise InvalidOption("language_mode must be 'strict'")
        if self.reverse_mode not in ("distance", "score"):
            raise InvalidOption("reverse_mode must be 'distance' or 'score'")
        if limit is not None and limit < 1:
            raise InvalidOption("limit must be positive")
        if reverse and (limit or 1) > 1 and len(types or ()) != 1:
            raise InvalidOption("limit needs exactly one type in reverse queries")
        limit = min(limit or 1, 5) if reverse else min(limit or 5, 10)
        return replace(self, types=types, stacks=stacks, limit=limit, worldview=self.worldview or (views[0] if views else None))
