"""Bit masks of query tokens, score scales and relevance arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import half_up

KEY_RANGE = 1 << 24
IDX_STRIDE = 1 << 25


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def power_of_two(n) -> Column:
    return F.pow(F.lit(2.0), _c(n)).cast("bigint")


def span_mask(start, length) -> Column:
    """Mask of ``length`` tokens from ``start``."""
    return (power_of_two(length) - 1) * power_of_two(start)


def contiguous_masks(n) -> Column:
    """Masks of all contiguous spans of n tokens, longest first, then leftmost first."""
    n = _c(n)
    by_length = F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: span_mask(i, n - k + 1)))
    return F.when(n > 0, F.flatten(by_length)).otherwise(F.array().cast("array<bigint>"))


def all_masks(n) -> Column:
    """Masks of all non-empty subsets of n tokens."""
    return F.sequence(F.lit(1).cast("bigint"), power_of_two(n) - 1)


def masked(tokens, mask) -> Column:
    """The tokens that a mask has."""
    return F.filter(_c(tokens), lambda t, i: F.floor(_c(mask) / power_of_two(i)) % 2 == 1)


def low_bit(mask) -> Column:
    """Index of the lowest set bit, -1 for none."""
    m = _c(mask)
    return F.when(m == 0, -1).otherwise(F.bit_count(m.bitwiseAND(-m) - 1)).cast("int")


def mask_bounds(mask) -> Column:
    """struct(first, last) of the first run of set bits; -1 and -1 for none."""
    m = _c(mask)
    first = low_bit(m)
    # adding the lowest bit carries through the run; its end is the carry's place
    last = low_bit((m + m.bitwiseAND(-m)).bitwiseAND(F.bitwise_not(m))) - 1
    return F.struct(first.alias("first"), F.when(m == 0, -1).otherwise(last).cast("int").alias("last"))


def covers_windows(mask, windows) -> Column:
    """Whether a mask has each of the windows in full or not at all."""
    return F.forall(_c(windows), lambda w: (_c(mask).bitwiseAND(w) == 0) | (_c(mask).bitwiseAND(w) == w))


def required_masks(owner) -> Column:
    """Masks of the runs of tokens that came from one token of the query: a match has to take each in full or not at all.
    ``owner``: for each token the number of the one it came from."""
    o = _c(owner)
    at = F.when(F.size(o) > 0, F.sequence(F.lit(0), F.size(o) - 1)).otherwise(F.array().cast("array<int>"))
    run = lambda x: F.aggregate(at, F.lit(0).cast("bigint"), lambda a, i: a + F.when(F.get(o, i) == x, power_of_two(i)).otherwise(F.lit(0)))
    return F.filter(F.transform(F.array_distinct(o), run), lambda m: F.bit_count(m) > 1)


def gap_masks(tokens) -> Column:
    """Masks that add tokens which vanished from a query ("" in their place) to the neighbour before them, and to the one after."""
    t = _c(tokens)
    n = F.size(t)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    gone = lambda i: F.coalesce(F.get(t, i) == "", F.lit(False))

    def masks(start):
        end = F.coalesce(F.array_min(F.filter(at, lambda i: (i > start) & ~gone(i))), n)
        before, after = span_mask(start - 1, end - start + 1), span_mask(start, end - start + 1)
        return F.when(end == n, F.array(before)).when(start > 0, F.array(before, after)).otherwise(F.array(after))

    return F.flatten(F.transform(F.filter(at, lambda i: gone(i) & ~gone(i - 1)), masks))


def cover_gaps(mask, gaps) -> Column:
    """A match's mask, and those it has with the gaps that it touches."""
    m = _c(mask)
    return F.array_distinct(F.concat(F.array(m), F.transform(F.filter(_c(gaps), lambda g: g.bitwiseAND(m) != 0), lambda g: g.bitwiseOR(m))))


def encode_log_scale(n, most) -> Column:
    """Score on a 3-bit logarithmic scale: ceil(7 ln n / ln most), logarithms in single precision; 1 gives
    1, null and what isn't above 0 give 0."""
    ln = lambda v: F.ln(_c(v)).cast("float").cast("double")
    scaled = F.ceil(7 * ln(n) / F.nullif(ln(most), F.lit(0.0)))
    return F.coalesce(F.when(_c(n) == 1, 1).when(_c(n) > 0, scaled), F.lit(0)).cast("int")


def decode_log_scale(n, most) -> Column:
    return half_up(F.pow(_c(most).cast("double"), _c(n) / 7))


def feature_key(id_) -> Column:
    return F.pmod(F.abs(_c(id_)), F.lit(KEY_RANGE))


def tmpid(idx, id_) -> Column:
    return _c(idx) * IDX_STRIDE + feature_key(id_)


def encode_grid(x, y, relev, score, key) -> Column:
    """A posting in one BIGINT: 14-bit x and y, 2-bit relevance (0.4 to 1), 3-bit score, 20-bit key."""
    r = (half_up(_c(relev) * 5) - 2).cast("bigint")
    parts = [(r, 2**51), (_c(score), 2**48), (_c(x), 2**34), (_c(y), 2**20)]
    return sum((p.cast("bigint") * n for p, n in parts), F.pmod(_c(key).cast("bigint"), F.lit(2**20)))


def decode_grid(grid) -> Column:
    g = _c(grid)
    part = lambda low, width: F.floor(g / F.lit(2**low)).cast("bigint") % (2**width)
    return F.struct(
        part(34, 14).alias("x"), part(20, 14).alias("y"), ((part(51, 2) + 2) / 5).alias("relev"), part(48, 3).alias("score"), part(0, 20).alias("key"),
    )


def span_weight(n_span, n_query, distance=0, phrase_length=None, last_order=None) -> Column:
    """Share of the query that a match covers, less for an edit and for a number in the wrong place."""
    w = _c(n_span) / _c(n_query)
    if phrase_length is not None:
        n = F.greatest(_c(phrase_length), F.lit(1))
        w = w * F.greatest((n - _c(distance) / 2) / n, F.lit(0.75))
    return w * F.when(_c(last_order), 0.99).otherwise(1.0) if last_order is not None else w


def rebalance(relevs, masks, n_tokens, stack_relev=None) -> Column:
    """struct(relevs, relev): a stack's entry relevances, each drawn towards
    an equal share, and the stack's own. A token that no entry covers takes a share too."""
    r, m, n = _c(relevs), _c(masks), _c(n_tokens)
    union = F.aggregate(m, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    k = F.size(r)
    share = 1.0 / F.when(F.bit_count(union) < n, k + 1).otherwise(k)
    new = F.transform(r, lambda x, i: half_up((x + 1.25 * share * (x / (F.bit_count(F.get(m, i)) / n))) / 2.25, 8))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    penalty = total(r) - (_c(stack_relev) if stack_relev is not None else total(r))
    return F.struct(new.alias("relevs"), F.least(half_up(total(new) - penalty, 8), F.lit(1.0)).alias("relev"))
