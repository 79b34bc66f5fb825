"""Sources and sinks: documents in, index tables out and in again."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.config import Source
from waymark.functions import shapes
from waymark.operators.index import Index, upsert
from waymark.schema import complete

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
STRINGS = T.MapType(T.StringType(), T.StringType())
#: A feature document as stored.
FEATURE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_lang", STRINGS),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("stack", T.StringType()),
        T.StructField("reverse_only", T.BooleanType()),
        T.StructField("ring", T.ArrayType(POINT)),
        T.StructField("props", STRINGS),
        T.StructField("line", T.ArrayType(POINT)),
        T.StructField("points", T.ArrayType(T.StructType([T.StructField("num", T.StringType()), *POINT.fields, T.StructField("style", T.StringType())]))),
        T.StructField(
            "ranges",
            T.ArrayType(T.StructType([*[T.StructField(k, T.IntegerType()) for k in ("i", "lf", "lt", "rf", "rt")], T.StructField("lp", T.StringType()), T.StructField("rp", T.StringType()), T.StructField("line", T.ArrayType(POINT))])),
        ),
        T.StructField("intersections", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), *POINT.fields]))),
        T.StructField("formats", STRINGS),
        T.StructField("overrides", STRINGS),
    ]
)
#: The raw GeoJSON document: coordinates stay text, because their nesting depends on the type.
GEOJSON = "id bigint, type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".geojsonl": "json", ".csv": "csv"}


def load(spark: SparkSession, uri: str, schema: T.StructType | None = None) -> DataFrame:
    """A source by its extension; a name with a protocol of its own (``parquet:/path``) by that."""
    scheme = urlparse(uri).scheme
    if scheme in FORMATS.values():
        kind, uri = scheme, uri[len(scheme) + 1 :]
    else:
        ext = os.path.splitext(uri.rstrip("/"))[1].lower()
        if ext not in FORMATS:
            raise ValueError(f"unknown kind of source: {uri}")
        kind = FORMATS[ext]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(uri)
    return reader.option("mode", "FAILFAST").json(uri) if kind == "json" else reader.format(kind).load(uri)


def load_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every file or table of a directory, on whatever file system Spark knows, as a source, by its name without extension; hidden
    ones don't count."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    kept = [n for n in names if not n.startswith((".", "_")) and os.path.splitext(n)[1].lower() in FORMATS]
    return {os.path.splitext(n)[0]: load(spark, f"{folder.rstrip('/')}/{n}") for n in kept}


def from_geojson(raw: DataFrame, source: str) -> DataFrame:
    """GeoJSON feature documents (text column ``value``, one a line) as ``FEATURE`` rows; blank lines are skipped,
    a line that is no JSON fails the job. ``center``, ``score``, ``text`` and ``text_<language>`` are properties."""
    doc = F.from_json("value", GEOJSON, {"mode": "FAILFAST"})
    rows = raw.where(F.trim("value") != "").select(doc.alias("d")).select("d.*")
    p = lambda k: F.try_element_at("properties", F.lit(k))
    plain = F.transform_keys("properties", lambda k, v: F.regexp_replace(k, "^[a-z]+:", ""))
    rows = rows.withColumn("properties", plain)
    center = F.from_json(p("center"), "array<double>")
    coords = lambda kind, t: F.when(F.col("geometry.type") == kind, F.from_json("geometry.coordinates", t))
    pt = lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))
    point = coords("Point", "array<double>")
    many = coords("MultiPoint", "array<array<double>>")
    outer = coords("Polygon", "array<array<array<double>>>")[0]
    ring = F.transform(outer, pt)
    single = F.transform(coords("LineString", "array<array<double>>"), pt)
    lines = F.coalesce(F.transform(coords("MultiLineString", "array<array<array<double>>>"), lambda ln: F.transform(ln, pt)), F.when(single.isNotNull(), F.array(single)))
    mean = lambda i: F.aggregate(outer, F.lit(0.0), lambda a, c: a + c[i]) / F.size(outer)
    langs = F.transform_keys(F.map_filter("properties", lambda k, v: F.startswith(k, F.lit("text_"))), lambda k, v: F.substring(k, 6, 99))
    formats = F.transform_keys(F.map_filter("properties", lambda k, v: (k == "format") | F.startswith(k, F.lit("format_"))), lambda k, v: F.when(k == "format", "").otherwise(F.substring(k, 8, 99)))
    overrides = F.transform_keys(F.map_filter("properties", lambda k, v: F.startswith(k, F.lit("override:"))), lambda k, v: F.substring(k, 10, 99))
    # parallel arrays: house numbers or crossing streets with the points of a MultiPoint, range ends with the lines
    numbers = F.from_json(p("addressnumber"), "array<string>")
    crossings = F.from_json(p("intersections"), "array<string>")
    styles = p("addressstyle")
    paired = lambda names, fn: F.when(F.size(names) == F.size(many), F.zip_with(names, many, fn)).when(names.isNotNull(), F.raise_error(F.lit("as many numbers or names as points are asked for")).cast("void"))
    points = paired(numbers, lambda n, c: F.struct(F.lower(n).alias("num"), c[0].alias("lon"), c[1].alias("lat"), styles.alias("style")))
    crossed = paired(crossings, lambda n, c: F.struct(n.alias("name"), c[0].alias("lon"), c[1].alias("lat")))
    side = lambda k, t="array<int>": F.from_json(p(k), t)
    ends = {"lf": side("lfromhn"), "lt": side("ltohn"), "rf": side("rfromhn"), "rt": side("rtohn"), "lp": side("parityl", "array<string>"), "rp": side("parityr", "array<string>")}
    ranges = F.when(p("rangetype").isNotNull(), F.transform(lines, lambda ln, i: F.struct(i.alias("i"), *[F.get(v, i).alias(k) for k, v in ends.items()], ln.alias("line"))))
    middle = lambda i: F.coalesce(many[0][i], lines[0][0]["lon" if i == 0 else "lat"])
    known = ["text", "center", "score", "types", "geocoder_stack", "reverse_only", "format", "addressnumber", "addressstyle", "intersections", "rangetype", "lfromhn", "ltohn", "rfromhn", "rtohn", "parityl", "parityr"]
    rest = F.map_filter("properties", lambda k, v: ~k.isin(known) & ~F.rlike(k, F.lit("^(text_|format_|override:)")))
    return rows.select(
        F.lit(source).alias("source"), "id", p("text").alias("text"), langs.alias("text_lang"),
        F.coalesce(center[0], point[0], mean(0), middle(0)).alias("lon"), F.coalesce(center[1], point[1], mean(1), middle(1)).alias("lat"),
        F.expr("try_cast(try_element_at(properties, 'score') as double)").alias("score"),
        F.from_json(p("types"), "array<string>").alias("types"), p("geocoder_stack").alias("stack"), (p("reverse_only") == "true").alias("reverse_only"), ring.alias("ring"), rest.alias("props"),
        F.when(ranges.isNull(), lines[0]).alias("line"), points.alias("points"), ranges.alias("ranges"), crossed.alias("intersections"), F.when(F.size(formats) > 0, formats).alias("formats"), F.when(F.size(overrides) > 0, overrides).alias("overrides"),
    )


def read_geojson(spark: SparkSession, path: str, source: str) -> DataFrame:
    return from_geojson(spark.read.text(path), source)


def memory(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A source from rows in memory."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in FEATURE.fields) for r in rows], FEATURE)


#: What a feature keeps where only its place and name are looked up.
LIGHT = ("source", "id", "text", "text_lang", "types", "stack", "score", "lon", "lat")


def storable(features: DataFrame, light: bool = False) -> DataFrame:
    """The stored columns only; ``light``: those of the tile table."""
    names = LIGHT if light else FEATURE.names
    return features.select(*[c for c in features.columns if c in names])


def cleaned(features: DataFrame, sources: list[Source]) -> DataFrame:
    """Without the shapes of layers that have no addresses: their tiles hold what lookups need."""
    addressed = F.col("source").isin([s.name for s in sources if s.is_address])
    return features.withColumns({c: F.when(addressed, F.col(c)) for c in ("ring", "line") if c in features.columns})


def vectors(features: DataFrame) -> DataFrame:
    """What a tiler takes: one GeoJSON line (source, id, json) for each address point, crossing and range, or the whole shape of features that have
    none; properties are the light columns."""
    rows = shapes.parts(complete(features))
    part = F.col("part")
    pair = lambda p: F.array(p["lon"], p["lat"])
    coords = F.when(part["kind"] == "point", F.to_json(F.array(part["lon"], part["lat"]))).when(part["kind"] == "line", F.to_json(F.transform(part["line"], pair))).otherwise(F.to_json(F.array(F.transform(part["line"], pair))))
    kind = F.when(part["kind"] == "point", "Point").when(part["kind"] == "line", "LineString").otherwise("Polygon")
    props = F.to_json(F.struct(*[c for c in LIGHT if c in rows.columns and c not in ("lon", "lat")]))
    return rows.select("source", "id", F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}")).alias("json"))


def write_index(index: Index, path: str) -> None:
    """The index as Parquet, the tables for prefix, one-edit and place lookups with it: by source, sorted by what lookups ask for, so that
    they skip files."""
    index.sources.write.mode("overwrite").parquet(f"{path}/sources")
    index.features.write.mode("overwrite").partitionBy("source").parquet(f"{path}/features")
    tables = {"grid": (index.grid, ("phrase", "x", "y")), "phrases": (index.phrases, ("phrase",)), "prefixes": (index.prefix_rows(), ("prefix",)), "deletions": (index.deletion_rows(), ("variant",)), "places": (index.place_rows(), ("zoom", "x", "y"))}
    for name, (table, keys) in tables.items():
        ranged = table.repartitionByRange("source", *keys).sortWithinPartitions("source", *keys)
        ranged.write.mode("overwrite").partitionBy("source").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("sources", "features", "phrases", "grid", "prefixes", "deletions", "places")])


class MemoryStore:
    """Features by (source, id) in memory, with a log of what was asked of it: ``log`` counts gets and puts by source."""

    def __init__(self, spark: SparkSession):
        self.spark, self.log = spark, Counter()
        self.table = memory(spark, [])

    def put(self, rows: list[dict]) -> None:
        """The last one put of equal (source, id) stays."""
        for source, n in Counter(r["source"] for r in rows).items():
            self.log["put", source] += n
        gone = {(r["source"], r["id"]) for r in rows}
        kept = [r.asDict(True) for r in self.table.collect() if (r.source, r.id) not in gone]  # a store in memory, by name
        self.table = memory(self.spark, kept + list({(r["source"], r["id"]): r for r in rows}.values()))

    def get(self, source: str, ids: list[int]) -> DataFrame:
        self.log["get", source] += len(ids)
        return get_features(self.table, self.spark.createDataFrame([(source, i) for i in ids], "source string, id bigint"))


def get_features(features: DataFrame, keys: DataFrame) -> DataFrame:
    """The features of keys (source, id); keys that aren't there have no row."""
    return features.join(keys.select("source", "id").distinct(), ["source", "id"])


def put_features(spark: SparkSession, path: str, new: DataFrame, version: int) -> None:
    """Features written over those of a table in a folder: of equal (source, id) those of the highest version hold. A version's files are replaced
    as a whole, so writing it again changes nothing."""
    new.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def stored_features(spark: SparkSession, path: str) -> DataFrame:
    """What ``put_features`` has put: one row for each (source, id)."""
    every = spark.read.option("mergeSchema", "true").parquet(path)
    return upsert(every, every.limit(0), "version").drop("version")


def shards(features: DataFrame) -> DataFrame:
    """Features as key and JSON, in order of key: what a key-value store would hold."""
    return features.select("source", F.col("id").alias("shard"), F.to_json(F.struct("*")).alias("json")).orderBy("source", "shard")


def iterate_shards(features: DataFrame) -> Iterator[tuple[str, int, str]]:
    """(source, shard, json) in order of key, a partition at a time."""
    for r in shards(features).toLocalIterator(prefetchPartitions=True):
        yield r.source, r.shard, r.json


def serialized(features: DataFrame) -> DataFrame:
    """source, shard, data: shards in base 64, as a text store would hold them."""
    return shards(features).select("source", "shard", F.base64(F.encode("json", "utf-8")).alias("data"))


def to_geojson(results: DataFrame) -> DataFrame:
    """Result rows (query_id, rank, id, place_name, lon, lat, ...) as one FeatureCollection per query."""
    rest = [c for c in results.columns if c not in ("query_id", "rank", "id", "place_name", "lon", "lat")]
    feature = F.struct(
        F.lit("Feature").alias("type"), "id", "place_name", F.array("lon", "lat").alias("center"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties") if rest else F.struct(F.lit(0).alias("n")).alias("properties"),
    )
    grouped = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", feature.alias("f")))).alias("fs"))  # at most ten a query
    return grouped.select("query_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("geojson"))
