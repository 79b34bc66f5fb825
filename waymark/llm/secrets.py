"""Secret scans by a trigram inverted index, with DataFrame and SQL functions only.

Each rule's regex is parsed on the driver into a Boolean query over trigrams of case-folded text: an OR
of ANDs that every text with a match satisfies. The index has a posting (trigram, doc_id) for each
trigram that some query names and each document that contains it. A query's ANDs are
intersected by counting up bits per (document, AND); documents that satisfy a query are
candidates for its rule, and only there does the regex run. A rule without mandatory trigrams (``hex``) runs
over every text.

Spans. Matches of a rule are leftmost and don't overlap; those of too short a value are dropped after
matching. Offsets are code points, from the lengths of what lies between the matches, summed up by doubling
steps; texts are cut at spans by halving. So time grows with a text's length, and with its number of matches n as n log n.

Edge cases: a null text is empty; a document with a null doc_id has no posting and is scanned by every
rule; of rows that repeat a doc_id each is scanned if any satisfies the query; texts are whole; an
empty table gives no rows. "Either case" means the 52 ASCII letters: what Unicode folds to them (the long s, the
Kelvin sign, dotless i) doesn't count. Only named columns are read, but ``redact`` keeps all of them.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import materialize, small_or_shuffled

MAX_EXACT = 48
#: Doubling steps of running sums: enough for the longest array that Spark holds.
MAX_STEPS = 31
SPANS = "array<struct<start:int,ord:int,stop:int,kind:string,size:int>>"


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: the group whose length decides whether a match counts, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A word (or part of a pattern) in ASCII letters of either case, spelled out so that every engine agrees."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


BASE = (
    Rule("assign", rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run of these characters is matched whole, so a least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", rf"{either_case('bearer')}\x20+[A-Za-z0-9._~+/=-]{{20,}}"),
)
RULES = BASE + EXTRA

#: A query is a set of alternatives, each a set of trigrams; ``ANY`` holds for every text.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _or(a: Query, b: Query) -> Query:
    return _least(a | b)


def _least(q: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: frozenset[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _or(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """Of a parsed sequence: all strings it matches if they are few (folded), and its query."""
    exact: frozenset[str] | None = frozenset([""])
    run, query = frozenset([""]), ANY

    def flush():
        nonlocal run, query, exact
        query, run, exact = _and(query, _of_strings(run)), frozenset([""]), None

    for op, arg in items:
        strings, own = None, ANY
        if op is sre.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MAX_EXACT:
                    chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
                else:
                    chars = None
                    break
            strings = frozenset(chars) if chars and len(chars) <= 8 else None
        elif op is sre.SUBPATTERN:
            strings, own = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = frozenset()
            for _, q in parts:
                own = _or(own, q)
            if all(x is not None for x, _ in parts):
                strings = frozenset().union(*(x for x, _ in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            inner, q = _walk(sub)
            own = q if low else ANY
            if inner is not None and high == 1:
                strings = inner | ({""} if low == 0 else frozenset())
            elif inner is not None and low == high and low * len(inner) <= MAX_EXACT and len(inner) == 1:
                strings = frozenset(x * low for x in inner)
        elif op is sre.AT:
            continue
        if strings is not None and len(strings) * len(run) <= MAX_EXACT:
            run = frozenset(a + b for a in run for b in strings)
            exact = run if exact is not None else None
        else:
            flush()
            if strings is not None:
                own = _and(own, _of_strings(strings))
            query = _and(query, own)
    query = _and(query, _of_strings(run))
    return (run if exact is not None else None), query


def trigram_query(pattern: str) -> Query:
    """The alternatives of trigrams, folded to lower case, of which every text with a match has one in full."""
    return _walk(sre_parser.parse(pattern))[1]


def trigram_postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index restricted to ``trigrams``: (trigram, doc_id), trigram as its ordinal."""
    folded = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("folded"))
    found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return folded.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(doc_id, rules as bits) of documents that satisfy a rule's query; bits of the rules that
    have to scan every text."""
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    full = sum(1 << i for i, q in enumerate(queries) if frozenset() in q)
    named = sorted({t for i, q in enumerate(queries) if not full >> i & 1 for alternative in q for t in alternative})
    terms, needs = [], []
    for i, q in enumerate(queries):
        if full >> i & 1:
            continue
        for alternative in sorted(q, key=sorted):
            for bit, t in enumerate(sorted(alternative)):
                terms.append((named.index(t), len(needs), 1 << bit))
            needs.append((len(needs), (1 << len(alternative)) - 1, 1 << i))
    postings = trigram_postings(docs, named, id_col, text_col)
    # both tables have a row for each trigram of a rule: their size doesn't depend on the documents
    terms_df = F.broadcast(spark.createDataFrame(terms, "trigram int, alternative int, bit bigint"))
    needs_df = F.broadcast(spark.createDataFrame(needs, "alternative int, need bigint, rule bigint"))
    met = postings.join(terms_df, "trigram").groupBy("doc_id", "alternative").agg(F.bit_or("bit").alias("have"))
    return met.join(needs_df, "alternative").where("have = need").groupBy("doc_id").agg(F.bit_or("rule").alias("rules")), full


def _running(a: str) -> str:
    """Running sums of an array of ints, as SQL: after step k every element holds the sum of the 2^k up to it."""
    steps = f"sequence(0, least({MAX_STEPS}, cast(ceil(log2(greatest(size({a}), 1))) as int)))"
    return f"aggregate({steps}, {a}, (s, k) -> if(shiftleft(1, k) >= size(s), s, transform(s, (x, i) -> x + coalesce(get(s, i - shiftleft(1, k)), 0))))"


def _let(name: str, value: str, body: str) -> str:
    """SQL with a value computed once under a name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _spans(rule: Rule, text: str, order: int):
    """Array of struct(start, kind order, end, kind) of a rule's matches, as SQL."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    lengths = lambda a: f"transform({a}, c -> char_length(c))"
    found = f"named_struct('m', {lengths(f"regexp_extract_all({text}, '{pattern}', 0)")}, 'v', {lengths(f"regexp_extract_all({text}, '{pattern}', {rule.group})")}, 'g', {lengths(f"split({text}, '{pattern}', -1)")})"
    ends = _running("zip_with(f.m, slice(f.g, 1, size(f.m)), (m, g) -> m + g)")
    span = f"named_struct('start', get(e, i) - m, 'ord', {order}, 'stop', get(e, i), 'kind', '{rule.kind}', 'size', get(f.v, i))"
    spans = f"transform(f.m, (m, i) -> {span})"
    return F.expr(f"filter({_let('f', found, _let('e', ends, spans))}, s -> s.size >= {rule.least})")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and ``__secret_spans``: array of struct(start, ord, stop, kind, size) by start, then rule."""
    found, full = candidates(docs, rules, id_col, text_col)
    found = materialize(found, "candidates")
    marks = found.select(F.col("doc_id").alias("__secret_id"), F.col("rules").alias("__secret_rules"))
    joined = docs.join(small_or_shuffled(marks), F.col(id_col) == F.col("__secret_id"), "left")
    every = (1 << len(rules)) - 1
    bits = F.when(F.col(id_col).isNull(), F.lit(every)).otherwise(F.coalesce("__secret_rules", F.lit(0))).bitwiseOR(F.lit(full))
    ready = joined.withColumns({"__secret_bits": bits, "__secret_text": F.coalesce(F.col(text_col), F.lit(""))})
    none = F.lit(None).cast(SPANS)
    parts = []
    for i, rule in enumerate(rules):
        asked = (F.col("__secret_bits").bitwiseAND(F.lit(1 << i)) != 0) & F.rlike("__secret_text", F.lit(rule.pattern))
        parts.append(F.coalesce(F.when(asked, _spans(rule, "__secret_text", i)).otherwise(none), F.array().cast(SPANS)))
    return ready.withColumn("__secret_spans", F.array_sort(F.concat(*parts))).drop("__secret_id", "__secret_rules", "__secret_bits", "__secret_text")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the number of spans of each base kind, the digest of the base spans, all spans."""
    scanned = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    spans = F.col("__secret_spans")
    base = F.filter(spans, lambda s: s["ord"] < len(BASE))
    count = lambda i: F.size(F.filter(spans, lambda s: s["ord"] == i)).cast("long")
    return scanned.select(
        F.col("doc_id").alias(id_col), *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )


def _redacted(text: str, spans: str, mark: str) -> str:
    """SQL of a text with its spans (sorted by start, overlapping ones as one) replaced."""
    # a span starts a stretch of its own if it begins beyond the furthest end before it; prefix maxima by doubling
    steps = f"sequence(0, least({MAX_STEPS}, cast(ceil(log2(greatest(size({spans}), 1))) as int)))"
    reach = f"aggregate({steps}, transform({spans}, s -> s.stop), (a, k) -> if(shiftleft(1, k) >= size(a), a, transform(a, (x, i) -> greatest(x, coalesce(get(a, i - shiftleft(1, k)), 0)))))"
    starts = f"filter(transform({spans}, (s, i) -> if(i = 0 or s.start >= get(r, i - 1), i, -1)), i -> i >= 0)"
    # the ends of the pieces: text up to a stretch, the stretch, and so on; then what is left
    cuts = f"concat(flatten(transform(b, (i, j) -> array(get({spans}, i).start, get(r, coalesce(get(b, j + 1), size(r)) - 1)))), array(char_length({text})))"
    base = "if(p.lo = 0, 0, get(c, p.lo - 1))"
    at = "(p.lo + p.hi) div 2"
    halves = f"""array(named_struct('t', substring(p.t, 1, get(c, {at} - 1) - {base}), 'lo', p.lo, 'hi', cast({at} as int)),
                       named_struct('t', substring(p.t, get(c, {at} - 1) - {base} + 1), 'lo', cast({at} as int), 'hi', p.hi))"""
    rounds = "sequence(1, cast(ceil(log2(size(c))) as int))"
    pieces = f"aggregate({rounds}, array(named_struct('t', {text}, 'lo', 0, 'hi', size(c))), (a, k) -> flatten(transform(a, p -> if(p.hi - p.lo > 1, {halves}, array(p)))))"
    joined = f"array_join(transform({pieces}, (p, i) -> if(i % 2 = 1, '{mark}', p.t)), '')"
    return _let("r", reach, _let("b", starts, _let("c", cuts, joined)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with each found span of text (overlapping ones as one) replaced by ``mark``."""
    scanned = scan(docs, rules, id_col, text_col)
    body = "`" + text_col.replace("`", "``") + "`"
    quoted = mark.replace("\\", "\\\\").replace("'", "\\'")
    rebuilt = F.expr(_redacted(body, "__secret_spans", quoted))
    return scanned.withColumn(text_col, F.when(F.size("__secret_spans") > 0, rebuilt).otherwise(F.col(body))).drop("__secret_spans")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rules = ", ".join(f"({i}, '{r.kind}', {'$p$' + r.pattern + '$p$'}, {r.least})" for i, r in enumerate(RULES))
    # group 2 of the first rule, else the whole match
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
r(ord, kind, pattern, least) as (values {rules}),
m as (
  select rid, ord, kind, least, string_split_regex(text, pattern) as gaps, regexp_extract_all(text, pattern, 0) as ms,
         case when ord = 0 then regexp_extract_all(text, {'$p$' + BASE[0].pattern + '$p$'}, 2) else regexp_extract_all(text, pattern, 0) end as vs
  from d join r on regexp_matches(text, pattern)),
x as (
  select rid, ord, kind, least, length(ms[i]) as n, length(vs[i]) as size,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) as start
  from m, unnest(range(1, len(ms) + 1)) as t(i)),
s as (select rid, ord, start, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as span from x where size >= least),
a as (
  select rid, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access, count(*) filter (where ord = 2) as n_hex,
         coalesce(string_agg(span, ',' order by start, ord) filter (where ord < {len(BASE)}), '') as base, string_agg(span, ',' order by start, ord) as spans
  from s group by rid)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a on d.rid = a.rid
"""


SQL = _sql()
