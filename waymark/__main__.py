"""Command line: ``python -m waymark index|query|analyze``, to be run by itself or through spark-submit.

index    --source NAME=FILE[:ZOOM] ... --out DIR     GeoJSON feature files, coarse layers first
query    --index DIR [--types a,b] [--stacks a,b] [--bbox W,S,E,N] [--proximity LON,LAT] [--language a,b] [--worldview V] [--limit N] [--geojson] TEXT ...
analyze  --index DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from waymark.config import Options, Source, catalog
from waymark.operators import index as ix
from waymark.plans import geocode
from waymark.sources import readers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("index")
    build.add_argument("--source", action="append", required=True)
    build.add_argument("--out", required=True)
    ask = sub.add_parser("query")
    ask.add_argument("--index", required=True)
    ask.add_argument("--types")
    ask.add_argument("--proximity")
    ask.add_argument("--limit", type=int)
    for name in ("stacks", "bbox", "language", "worldview"):
        ask.add_argument(f"--{name}")
    ask.add_argument("--geojson", action="store_true")
    ask.add_argument("text", nargs="+")
    stats = sub.add_parser("analyze")
    stats.add_argument("--index", required=True)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("waymark").getOrCreate()
    if a.command == "index":
        sources, features = [], None
        for spec in a.source:
            name, _, path = spec.partition("=")
            path, _, zoom = path.partition(":")
            sources.append(Source(name, zoom=int(zoom or 6)))
            one = readers.read_geojson(spark, path, name)
            features = one if features is None else features.unionByName(one)
        readers.write_index(ix.build(features, catalog(spark, sources)), a.out)
        return
    index = readers.read_index(spark, a.index)
    if a.command == "analyze":
        ix.statistics(index.grid).orderBy("kind", "value").show(50, False)
        return
    split = lambda v, kind=str: None if v is None else tuple(map(kind, v.split(","))) if kind is float else v.split(",")
    o = Options(types=split(a.types), stacks=split(a.stacks), limit=a.limit, proximity=split(a.proximity, float), bbox=split(a.bbox, float), language=split(a.language), worldview=a.worldview)
    asked = spark.createDataFrame(list(enumerate(a.text)), "query_id bigint, query string")
    found = geocode.geocode(asked, index, o)
    if a.geojson:
        for r in readers.to_geojson(found).orderBy("query_id").toLocalIterator():
            print(r.geojson)
    else:
        found.orderBy("query_id", "rank").show(100, False)


if __name__ == "__main__":
    main()
