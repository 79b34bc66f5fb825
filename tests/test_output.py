"""Templates, result texts and address queries."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import template
from waymark.operators import output

L = F.lit


@pytest.mark.parametrize(
    "form, want",
    [
        ("{{address.number}} {{address.name}}, {{place.name}}, {{region.name}} {{postcode.name}}", "5 main st, paris"),
        ("{{#if region.name}}{{region.name}}{{else}}none{{/if}}", "none"),
        ('{{#eq place.name "paris"}}P{{/eq}}{{#isnt place.name "paris"}}Q{{/isnt}}', "P"),
        ("{{move_number_to_end house.name}}", "rue a 5"),
        ("{{{place.name}}} {{unknown}}", "paris"),
    ],
)
def test_templates(form, want):
    values = {"address": {"name": "main st", "number": "5"}, "place": {"name": "paris", "number": ""}, "house": {"name": "5 rue a"}}
    assert template.render(form, values) == want


def test_formatted_column(spark):
    item = lambda t, n, k: F.struct(L(t).alias("type"), L(n).alias("name"), L(k).cast("string").alias("number"))
    c = F.array(item("address", "main st", "5"), item("place", "paris", None))
    row = spark.range(1).select(template.formatted(c, None), template.formatted(c, "{{place.name}}: {{address.number}}"), template.format_choice(F.create_map(L(""), L("x"), L("de"), L("y")), "de")).head()
    assert list(row) == ["5 main st, paris", "paris: 5", "y"]


def test_result_texts(spark):
    row = spark.range(1).select(
        output.matching_text(L("New York,Nueva York,NYC"), L("nueva york")), output.matching_text(L("New York,NYC"), L("new york")), output.crossing_street(L("First St,1st Street"), L("1st")),
        output.is_short_address(L("1# 11")), output.is_short_address(L("1# main")), output.shard(0, L(100)), output.address_key(F.array(L("main st")), F.array(L("place.1"))),
    ).head()
    assert list(row) == ["Nueva York", None, "1st Street", True, False, 1, "_ main st:place.1"]


def test_overrides(spark):
    pair = lambda t, x: F.struct(L(t).alias("type"), L(x).alias("text"))
    over = F.create_map(L("place"), L("Lyon"))
    row = spark.range(1).select(output.with_overrides(F.array(pair("place", "Paris"), pair("region", "R")), over, None), output.override_boost(L(0.98), over, F.array(pair("place", "lyon"))), output.override_boost(L(0.5), over, F.array(pair("place", "x")))).head()
    assert [x.text for x in row[0]] == ["Lyon", "R"] and row[1] == 1.0 and row[2] == 0.5
