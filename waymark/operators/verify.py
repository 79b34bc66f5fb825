"""Verification: how well a feature's hierarchy bears out the query, and the order of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ZOOM_NEAR_MISS, MAX_TEXT_NEAR_MISS = 8, 3

#: One element of a context, from fine to coarse. hit: this feature was matched. near: another feature of its layer was.
#: name: its own text. inherit, grant: whether its layer takes, and gives, score by alike names.
ELEMENT = "struct<hit:boolean,near:boolean,mask:bigint,relev:double,text:string,ndx:int,ignore:boolean,name:string,inherit:boolean,grant:boolean>"
NAMESAKE_BONUS, ORDER_BONUS = 0.01, 0.01


def relevance(context: Column, address_order: Column) -> Column:
    """Relevance of a context: the sum of what its features matched, each token once. A match against the
    direction set by the first two counts half; a near miss counts half, if its tokens are still free at
    the end. A known direction costs 0.01 unless it is the layer's own."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("close"), F.lit(-1).cast("bigint").alias("last"), F.lit(-1).alias("group"), F.lit(None).cast("string").alias("text"),
        F.lit("").alias("dir"), F.lit(0.0).alias("relev"), F.lit(0.0).alias("near"), F.lit(False).alias("ignore"), F.lit(0).alias("c"),
    )

    def step(a, e):
        near = ~e["hit"]
        skip = ~(e["hit"] | e["near"]) | (F.when(near, a["close"]).otherwise(a["used"]).bitwiseAND(e["mask"]) != 0)
        ignore = (a["group"] >= 0) & (e["ignore"] | a["ignore"])
        way = F.when((a["dir"] == "") & ~ignore & (a["c"] > 0), F.when(a["last"] < e["mask"], "ascending").otherwise("descending")).otherwise(a["dir"])
        turned = F.when(way == "ascending", a["last"] > e["mask"]).when(way == "descending", a["last"] < e["mask"]).otherwise(False)
        backy = (a["group"] > -1) & ~(e["text"].eqNullSafe(a["text"])) & turned & ~ignore
        gain = e["relev"] * F.when(backy, 0.5).otherwise(1.0)
        taken = F.struct(
            F.when(near, a["used"]).otherwise(a["used"].bitwiseOR(e["mask"])).alias("used"), F.when(near, a["close"].bitwiseOR(e["mask"])).otherwise(a["close"]).alias("close"), e["mask"].alias("last"), e["ndx"].alias("group"), e["text"].alias("text"),
            way.alias("dir"), (a["relev"] + F.when(near, 0.0).otherwise(gain)).alias("relev"), (a["near"] + F.when(near, gain * 0.5).otherwise(0.0)).alias("near"), e["ignore"].alias("ignore"), (a["c"] + 1).alias("c"),
        )
        left = F.struct(*[a[k].alias(k) for k in ("used", "close", "last", "group", "text", "dir", "relev", "near", "ignore")], (a["c"] + 1).alias("c"))
        return F.when(F.coalesce(skip, F.lit(True)), left).otherwise(taken)

    end = F.aggregate(context.cast(f"array<{ELEMENT}>"), start, step)
    fits = (end["close"] != 0) & (end["close"].bitwiseAND(end["used"]) == 0)
    total = end["relev"] + F.when(fits, end["near"]).otherwise(0.0)
    total = total - F.when(end["dir"] != "", ORDER_BONUS).otherwise(0.0) + F.when(end["dir"] == address_order, ORDER_BONUS).otherwise(0.0)
    return F.greatest(total + F.when(namesakes(context.cast(f"array<{ELEMENT}>")), NAMESAKE_BONUS).otherwise(0.0), F.lit(0.0))


def namesakes(context: Column) -> Column:
    """Whether a coarser feature that wasn't matched has the name of the first matched one beyond the target, their layers giving and
    taking score: 'main st new york' prefers new york, new york."""
    first = F.array_min(F.transform(context, lambda e, i: F.when((i > 0) & e["hit"] & F.coalesce(e["inherit"], F.lit(False)), i)))
    alike = lambda at: F.exists(F.transform(context, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: (x["i"] > at) & ~x["e"]["hit"] & ~x["e"]["near"] & F.coalesce(x["e"]["grant"], F.lit(False)) & F.contains(x["e"]["name"], F.split(F.get(context, at)["name"], ",")[0]))
    return F.when(first.isNotNull(), F.coalesce(alike(first), F.lit(False))).otherwise(False)


def order_features(rows: DataFrame, most: int) -> DataFrame:
    """Features before their hierarchies are known: adds rank, up to ``most`` per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("stack_relev"), F.asc(F.col("missing_address").cast("int")), F.asc(F.col("omitted").cast("int")), F.desc("scoredist"), "position")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def order_contexts(rows: DataFrame, most: int) -> DataFrame:
    """Verified results: adds rank, up to ``most`` per query."""
    has = set(rows.columns)
    near = [F.desc(F.col("inside_radius").cast("int"))] if "inside_radius" in has else []
    number = [F.asc_nulls_last("address_at")] if "address_at" in has else []
    w = Window.partitionBy("query_id").orderBy(
        F.desc("verified"), F.desc("relevance"), *near, F.desc("scoredist"), F.asc(F.col("omitted").cast("int")), F.desc("idx"), *number, F.asc(F.col("interpolated").cast("int")), "position", "id",
        *(["lon", "lat"] if {"lon", "lat"} <= has else []),
    )
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def good_contexts(rows: DataFrame) -> DataFrame:
    """query_id, good: how many results are borne out as well as their stack promised."""
    return rows.groupBy("query_id").agg(F.count_if(F.col("verified") >= F.col("stack_relev")).alias("good"))


def dedupe(rows: DataFrame, name: str = "place_name") -> DataFrame:
    """One result per query and place name (null: each its own), in the place of the first: the payload is that of the best of them, with a house
    number before without (column ``address``), not omitted before omitted, not interpolated before interpolated, then by rank. If
    any goes, the rest are put in order of relevance again (column ``verified``)."""
    w = Window.partitionBy("query_id", name)
    number = [F.col("address").isNull().cast("int")] if "address" in rows.columns else []
    best = F.row_number().over(w.orderBy(*number, F.col("omitted").cast("int"), F.col("interpolated").cast("int"), "rank"))
    kept = rows.withColumns({"_best": best, "_slot": F.min("rank").over(w)})
    kept = kept.withColumns({"_best": F.when(F.col(name).isNull(), 1).otherwise(F.col("_best")), "_slot": F.when(F.col(name).isNull(), F.col("rank")).otherwise(F.col("_slot"))})
    every = Window.partitionBy("query_id")
    kept = kept.withColumn("_gone", F.max((F.col("_best") > 1).cast("int")).over(every)).where(F.col("_best") == 1)
    lead = [F.desc(F.when(F.col("_gone") == 1, F.col("verified")))] if "verified" in rows.columns else []
    again = F.row_number().over(every.orderBy(*lead, "_slot"))
    return kept.withColumn("rank", again).drop("_best", "_slot", "_gone")


def squishy(rows: DataFrame) -> DataFrame:
    """Scores lent by peers: a result whose parent is a result too, of alike text, adds the parent's score. Columns
    query_id, tmpid, text, score, parents (array of tmpids): adds lent."""
    peers = rows.select(F.col("query_id").alias("q"), F.col("tmpid").alias("p"), F.col("text").alias("ptext"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("pscore")).distinct()
    up = rows.select("query_id", "tmpid", "text", F.explode("parents").alias("parent"))
    met = up.join(peers, (F.col("query_id") == F.col("q")) & (F.col("parent") == F.col("p")) & F.contains("ptext", F.split("text", ",")[0]))
    lent = met.groupBy("query_id", "tmpid").agg(F.sum("pscore").alias("lent"))
    return rows.join(lent, ["query_id", "tmpid"], "left").withColumn("lent", F.coalesce("lent", F.lit(0.0)))
