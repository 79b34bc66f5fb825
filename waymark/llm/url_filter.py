"""URL filters: a temporal list join.

A dated list has entries (pattern_kind, pattern, verdict, action, effective): from ``effective`` on, the
pattern is on the list with that verdict (action ``add``) or off it (``remove``). Per pattern the
entries become validity intervals, each up to the next entry. A capture is judged as of its fetch
time: it has one key per host suffix and per path prefix, equi-joined with the intervals under
from <= fetched < until. The most specific active pattern decides: longer path prefixes before whole
hosts, hosts before their parent domains; of one pattern's verdicts ``allow`` goes before ``block``.

A list of up to ``BROADCAST_ROWS`` intervals, counted, is broadcast: then only one row for each capture is shuffled. A
longer one is joined by shuffle, after captures' keys that aren't on it are gone, and keys with many captures are
spread over salts by their counts (``hot_join``).

pattern_kind ``domain``: the host and all below it; ``host``: exactly that host; ``prefix``: host and path
up to a segment's end.

Edge cases: scheme (it may be missing: ``//host/path``), user, port, query, fragment and dots at a host's end don't
count, and hosts fold to lower case; a null URL or one without a host, and a null fetch time, give verdict ``none``; entries with a null in any column
are ignored; repeated entries count once, and of entries of one pattern at one instant
the ``add`` holds, ``allow`` first; repeated captures each get a row; an empty list gives ``none`` for all, an
empty table no rows. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import BROADCAST_ROWS, hot_join, materialize

_BEFORE_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"


def host_of(url):
    """Lower-case host of a URL column; null without one."""
    authority = F.regexp_extract(url, _BEFORE_HOST + r"([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))
    return F.when(host != "", host)


def path_of(url):
    return F.regexp_extract(url, _BEFORE_HOST + r"[^/?#]*([^?#]*)", 1)


def keys_of(host, path):
    """Array of struct(rank, key): every pattern that may cover the capture. The rank orders them from
    general to specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("long").alias("rank"), F.concat(F.lit("domain "), F.array_join(F.slice(labels, n - i + 1, i), ".")).alias("key")))
    exact = F.array(F.struct(F.lit(1000).cast("long").alias("rank"), F.concat(F.lit("host "), host).alias("key")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    m = F.size(parts)
    prefixes = F.transform(
        F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((1000 + i).cast("long").alias("rank"), F.concat(F.lit("prefix "), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key")),
    )
    return F.concat(domains, exact, prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """key, verdict, since, until (null: still valid) from dated list entries."""
    e = entries.select(
        F.concat_ws(" ", F.lower("pattern_kind"), F.when(F.col("pattern_kind") == "prefix", F.regexp_replace("pattern", "/+$", "")).otherwise(F.lower("pattern"))).alias("key"),
        F.lower("verdict").alias("verdict"), F.lower("action").alias("action"), F.col("effective").cast("timestamp").alias("since"),
    ).dropna()
    # one state for each pattern and instant
    held = e.groupBy("key", "since").agg(
        F.min(F.when(F.col("action") == "add", F.when(F.col("verdict") == "allow", 0).otherwise(1))).alias("state")
    )
    w = Window.partitionBy("key").orderBy("since")
    return held.withColumn("until", F.lead("since").over(w)).where(F.col("state").isNotNull()).select("key", F.when(F.col("state") == 0, "allow").otherwise("block").alias("verdict"), "since", "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, fetched, host, verdict (block, allow or none), matched (the deciding pattern),
    listed_since."""
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched"))
    named = base.withColumn("host", host_of(F.col("url")))
    ask = named.where(F.col("host").isNotNull() & F.col("fetched").isNotNull())
    asked = ask.select("id", "url", "fetched", "host", F.inline(keys_of(F.col("host"), path_of(F.col("url")))))
    valid = materialize(intervals(entries), "intervals")
    if valid.count() <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(valid), "key")
    else:
        met = hot_join(materialize(asked.join(valid.select("key").distinct(), "key", "left_semi"), "asked"), valid, "key")
    active = met.where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    hits = active.select("id", "url", "fetched", "host", F.struct("rank", "key", "verdict", "since").alias("hit"), F.lit(0).alias("own"))
    own = named.select("id", "url", "fetched", "host", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(1).alias("own"))
    decided = hits.unionByName(own).groupBy("id", "url", "fetched", "host").agg(F.max("hit").alias("hit"), F.sum("own").cast("int").alias("copies"))
    return decided.select(
        F.col("id").alias(id_col), "fetched", "host", F.coalesce("hit.verdict", F.lit("none")).alias("verdict"),
        F.col("hit.key").alias("matched"), F.col("hit.since").alias("listed_since"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: page_id decides the day."""
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 365) as int))").alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """No list comes with the tables: the hosts' own digests decide which are listed, and when."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    day = lambda d: F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval((d).cast("int"))
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), ".")
    entry = lambda on, kind, pattern, verdict, action, when: F.when(on, F.struct(F.lit(kind).alias("pattern_kind"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), when.alias("effective")))
    made = F.array(
        entry(n % 3 == 0, "host", F.col("host"), "block", "add", day(n % 200)),
        entry(n % 3 == 0, "host", F.col("host"), "block", "remove", day(n % 200 + 60)),
        entry(n % 6 == 0, "host", F.col("host"), "block", "add", day(n % 200 + 120)),
        entry(n % 5 == 0, "domain", parent, "block", "add", day(n % 300)),
        entry(n % 7 == 0, "prefix", F.concat("host", F.lit("/en")), "allow", "add", day(n % 250)),
    )
    return hosts.select(F.inline(F.filter(made, lambda x: x.isNotNull()))).distinct()


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return judge(dated_captures(pages), dated_list(pages)).select("page_id", day("fetched"), "host", "verdict", "matched", day("listed_since"))


SQL = r"""
with p as (
  select page_id, url, timestamp '2024-01-01 00:00:00' + to_days(cast(((page_id * 37 % 365) + 365) % 365 as int)) as fetched,
         nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')), '') as host,
         list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages),
h as (select distinct host, string_split(host, '.') as labels, cast('0x' || substr(md5(host), 1, 6) as bigint) as n from p where host is not null),
e as (
  select distinct * from (
    select 'host ' || host as key, 1 as state, n % 200 as d from h where n % 3 = 0
    union all select 'host ' || host, null, n % 200 + 60 from h where n % 3 = 0
    union all select 'host ' || host, 1, n % 200 + 120 from h where n % 6 = 0
    union all select 'domain ' || array_to_string(labels[greatest(1, len(labels) - 2):greatest(1, len(labels) - 2) + 2], '.'), 1, n % 300 from h where n % 5 = 0
    union all select 'prefix ' || host || '/en', 0, n % 250 from h where n % 7 = 0)),
s as (select key, d, min(state) as state from e group by key, d),
v as (
  select key, case when state = 0 then 'allow' else 'block' end as verdict, timestamp '2024-01-01 00:00:00' + to_days(cast(d as int)) as since,
         timestamp '2024-01-01 00:00:00' + to_days(cast(next as int)) as until
  from (select *, lead(d) over (partition by key order by d) as next from s) where state is not null),
k as (
  select page_id, url, fetched, i as rank, 'domain ' || array_to_string(string_split(host, '.')[len(string_split(host, '.')) - i + 1:], '.') as key
  from p, unnest(range(1, len(string_split(host, '.')) + 1)) as t(i) where host is not null
  union all select page_id, url, fetched, 1000, 'host ' || host from p where host is not null
  union all select page_id, url, fetched, 1000 + i, 'prefix ' || host || '/' || array_to_string(parts[1:i], '/')
  from p, unnest(range(1, len(parts) + 1)) as t(i) where host is not null),
m as (
  select k.page_id, k.url, v.key, v.verdict, v.since, row_number() over (partition by k.page_id, k.url order by k.rank desc) as rn
  from k join v on k.key = v.key and v.since <= k.fetched and (v.until is null or k.fetched < v.until))
select p.page_id, strftime(p.fetched, '%Y-%m-%d') as fetched, p.host, coalesce(m.verdict, 'none') as verdict, m.key as matched,
       strftime(m.since, '%Y-%m-%d') as listed_since
from p left join m on p.page_id = m.page_id and p.url = m.url and m.rn = 1
"""
