"""The columns that a feature may have beyond source, id, text, lon and lat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "struct<lon:double,lat:double>"
OPTIONAL = {
    "score": "double",
    "text_lang": "map<string,string>",  # language -> texts
    "types": "array<string>",
    "stack": "string",
    "reverse_only": "boolean",
    "ring": f"array<{POINT}>",  # a polygon's outer ring, closed
    "line": f"array<{POINT}>",
    "points": "array<struct<num:string,lon:double,lat:double,style:string>>",  # addresses
    "ranges": f"array<struct<i:int,lf:int,lt:int,rf:int,rt:int,lp:string,rp:string,line:array<{POINT}>>>",
    "intersections": "array<struct<name:string,lon:double,lat:double>>",
    "formats": "map<string,string>",  # language -> template of the feature's own, the default under ""
    "overrides": "map<string,string>",  # type -> text in place of that layer's
    "props": "map<string,string>",
}


def complete(features: DataFrame) -> DataFrame:
    """The features with every optional column, null where they lack it."""
    return features.withColumns({k: F.lit(None).cast(t) for k, t in OPTIONAL.items() if k not in features.columns})
