"""Text functions as Column expressions: tokenising, normalising, house numbers, query shapes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import geo

#: Inside of a character class: white space and ASCII, general, supplemental and full-width punctuation.
SEPARATORS = (
    r"\s\x{00A0}\x{FEFF}\x{1680}\x{3000}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
    r"\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"
)
DROPPED = r"[\x{2018}\x{2019}\x{02BC}\x{02BB}\x{FF07}'.\^]"
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{20E3}]"
HYPHEN, SLASH = "", ""
MAX_QUERY_CHARS, MAX_QUERY_TOKENS = 256, 20


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_emoji(col) -> Column:
    return F.regexp_replace(_c(col), EMOJI, "")


def _glued(col: Column) -> Column:
    """Hides the - and / of numbers such as 1-2, 1/2 and 1-2/3a from the split."""
    ends = (rf"(?<![^{SEPARATORS}])", rf"(?![^{SEPARATORS}])")
    marks = (("-", HYPHEN), ("/", SLASH))
    for a, x in marks:
        for b, y in marks:
            col = F.regexp_replace(col, rf"{ends[0]}(\d+){a}(\d+){b}(\d+[a-z]?){ends[1]}", f"$1{x}$2{y}$3")
    for a, x in marks:
        col = F.regexp_replace(col, rf"{ends[0]}(\d+){a}(\d+[a-z]?){ends[1]}", f"$1{x}$2")
    return col


def tokenize(col) -> Column:
    """Lower-case tokens: apostrophes, periods and carets vanish, other punctuation separates, numbers such
    as 1-2 or 1/2a stay whole, each CJK ideograph is a token, emoji-only tokens are dropped. Null: null."""
    text = F.regexp_replace(F.lower(_c(col)), DROPPED, "")
    text = F.regexp_replace(_glued(text), r"([\x{4E00}-\x{9FFF}])", " $1 ")
    parts = F.filter(F.split(text, f"[{SEPARATORS}]+"), lambda t: remove_emoji(t) != "")
    return F.transform(parts, lambda t: F.translate(t, HYPHEN + SLASH, "-/"))


def _diacritics() -> tuple[str, str, dict[str, str]]:
    one_from, one_to = [], []
    many = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dz", "ŉ": "n"}
    plain = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N", "ð": "d", "Ð": "D", "ŧ": "t", "Ŧ": "T"}
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x622, 0x64B)]:
        ch = chr(cp)
        if ch in many:
            continue
        base = plain.get(ch) or "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and ch not in "йЙ":
            one_from.append(ch)
            one_to.append(base)
    return "".join(one_from), "".join(one_to), many


_FROM, _TO, _MANY = _diacritics()


def remove_diacritics(col) -> Column:
    """Latin, Greek, Cyrillic and Arabic letters without marks; ligatures spelled out."""
    out = F.translate(_c(col), _FROM, _TO)
    for a, b in _MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(\S)[\x{0300}-\x{036F}]+", "$1")


def normalize_text(col) -> Column:
    """Without diacritics and emoji, trimmed, inner white space single."""
    return F.trim(F.regexp_replace(remove_emoji(remove_diacritics(col)), r"\s+", " "))


def is_address(col) -> Column:
    """House-number-like tokens: 10, 10a, 10-19a, 6n23, w350n5337, 10к2с3."""
    return F.coalesce(
        F.rlike(_c(col), F.lit(r"^(\d+[a-z]?|\d+-\d+[a-z]?|\d+[nsew]\d+[a-z]?|[nesw]\d+([nesw]\d+)?|\d+(к\d+)?(с\d+)?)$")), F.lit(False)
    )


def parse_semi_number(col) -> Column:
    """The digits of a mixed token as one number; of korpus and stroenie numbers the leading digits."""
    c = _c(col)
    digits = F.regexp_replace(c, r"[^0-9]", "")
    first = F.regexp_extract(c, r"^(\d+)", 1)
    picked = F.when(F.rlike(c, F.lit("[кс]")), first).otherwise(digits)
    return F.when(picked != "", picked.cast("decimal(38,0)").cast("bigint"))


def mask_number(col) -> Column:
    """House-number mask: 1 -> #, 12 -> ##, 123 -> 1##, 12345 -> 12###."""
    c = _c(col)
    n = F.length(c)
    lead = F.when(n <= 2, 0).when(n == 3, 1).otherwise(2)
    return F.concat(F.substring(c, F.lit(1), lead), F.repeat(F.lit("#"), n - lead))


def mask_number_prefixes(col) -> Column:
    """The masks that a number typed so far may grow into: 5 -> #; 50 -> ##, 5#; 500 -> 5##, 50#; 5000 -> 50##."""
    c = _c(col)
    n = F.length(c)
    grown = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(mask_number(F.concat(c, F.repeat(F.lit("0"), k))), F.lit(1), n))
    return F.filter(F.array_distinct(grown), lambda m: m != c)


def number_variants(tokens) -> Column:
    """One copy of the tokens for each house number, with that number masked: array of struct(tokens, number,
    position)."""

    def variants(t: Column) -> Column:
        number = lambda x: is_address(x) & parse_semi_number(x).isNotNull()
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: geo.let(F.get(t, i), number))
        made = F.transform(
            at,
            lambda i: F.struct(
                F.transform(t, lambda x, j: F.when(j == i, geo.let(parse_semi_number(x).cast("string"), mask_number)).otherwise(x)).alias("tokens"),
                F.get(t, i).alias("number"),
                i.alias("position"),
            ),
        )
        return F.when(F.size(t) > 0, made)

    return geo.let(_c(tokens), variants)


def as_reverse(col) -> Column:
    """struct(lon, lat) of a query of exactly two numbers with a comma; otherwise null. An empty part
    counts as 0."""
    parts = F.split(_c(col), ",")
    number = lambda s: F.when(F.trim(s) == "", F.lit(0.0)).otherwise(F.when(F.rlike(F.trim(s), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), F.trim(s).cast("double")))
    lon, lat = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def as_id(col) -> Column:
    """struct(type, id) of a query ``type.digits``; otherwise null."""
    c = _c(col)
    kind, number = F.regexp_extract(c, r"^([A-Za-z0-9_-]+)\.(\d{1,18})$", 1), F.regexp_extract(c, r"^([A-Za-z0-9_-]+)\.(\d{1,18})$", 2)
    return F.when(number != "", F.struct(kind.alias("type"), number.cast("bigint").alias("id")))


def split_number_and_letters(col) -> Column:
    """White-space correction: 100main -> 100 main; ordinals such as 21st stay."""
    c = _c(col)
    ordinal = F.rlike(F.lower(c), F.lit(r"^\d+(st|nd|rd|th)\b"))
    return F.when(ordinal, c).otherwise(F.regexp_replace(c, r"(^|\s)(\d+)(?!(?:st|nd|rd|th)\b)(\p{L}{2,})", "$1$2 $3"))


def move_number_to_end(col) -> Column:
    return F.regexp_replace(_c(col), r"^(\d+) ([^\d]+)$", "$2 $1")


def intersection_text(a, b) -> Column:
    """The two indexed forms of a crossing: '+intersection a , b' and the other way round."""
    one = lambda x, y: F.concat(F.lit("+intersection "), _c(x), F.lit(" , "), _c(y))
    return F.array(one(a, b), one(b, a))


def replace_words(tokens, rules: dict[str, str]) -> Column:
    """Word-by-word replacement from a dictionary."""
    if not rules:
        return _c(tokens)
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.transform(_c(tokens), lambda t: F.coalesce(F.try_element_at(table, t), t))


def replace_patterns(col, rules: dict[str, str]) -> Column:
    """Global patterns, case-insensitive, in order, over the whole query."""
    out = _c(col)
    for pattern, to in rules.items():
        out = F.regexp_replace(out, f"(?iu){pattern}", to)
    return out


def text_alike(target, candidate) -> Column:
    """Whether the first synonym of ``target`` lies within ``candidate`` (null-safe: false)."""
    first = F.split(_c(target), ",")[0]
    return F.coalesce(F.contains(_c(candidate), first) & (first != ""), F.lit(False))


def damerau_within_one(a, b) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns a into b."""
    x, y = _c(a), _c(b)
    n = F.length(x)
    swapped = F.exists(
        F.when((n == F.length(y)) & (n >= 2), F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, n)) == y,
    )
    return (F.levenshtein(x, y, 1) >= 0) | swapped


def deletions(col) -> Column:
    """A phrase and all of its one-character deletions: two phrases one edit apart share one."""
    c = _c(col)
    n = F.length(c)
    cut = F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), cut))
