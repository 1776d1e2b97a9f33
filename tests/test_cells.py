"""The spherical grid: equal areas, parents, neighbours; and typed schema evolution."""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.functions.geo import cell_centre, cell_neighbours, cell_parent, haversine_nm, sphere_cell
from glidepath.sources import envelopes


def sphere(spark, n=20_000):
    """Points spread evenly over the sphere (a Fibonacci lattice)."""
    turn = math.pi * (1 + 5 ** 0.5)
    return spark.range(n).select(F.degrees(F.asin(1 - (F.col("id") + 0.5) * (2.0 / n))).alias("lat"),
                                 (F.degrees(F.col("id") * turn) % 360 - 180).alias("lon"))


def test_areas_are_alike_everywhere(spark):
    rows = sphere(spark, 400_000).groupBy(sphere_cell("lat", "lon", 4).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("lat")).alias("lat")).toPandas()
    assert len(rows) == 6 * 4**4
    mean = rows["n"].mean()
    assert rows["n"].max() / rows["n"].min() < 1.7 and rows["n"].std() / mean < 0.2
    low, high = rows[rows["lat"] < 15]["n"].mean(), rows[rows["lat"] > 75]["n"].mean()
    assert abs(low / high - 1) < 0.15  # a grid in degrees is off by a factor of four and more here


def test_parents_hold_their_cells(spark):
    rows = sphere(spark).select(sphere_cell("lat", "lon", 9).alias("c"), sphere_cell("lat", "lon", 5).alias("p"))
    assert rows.where(cell_parent("c", 4) != F.col("p")).count() == 0


def test_centres_and_neighbours(spark):
    cells = [r[0] for r in sphere(spark, 30_000).select(sphere_cell("lat", "lon", 3)).distinct().collect()]
    rows = spark.createDataFrame([(c,) for c in cells], "c bigint").select("c", cell_centre("c", 3).alias("m"), cell_neighbours("c", 3).alias("near")).collect()
    again = spark.createDataFrame([(r["c"], r["m"]["lat"], r["m"]["lon"]) for r in rows], "c bigint, lat double, lon double")
    assert len(cells) == 6 * 4**3 and again.where(sphere_cell("lat", "lon", 3) != F.col("c")).count() == 0
    pairs = [(r["c"], d) for r in rows for d in r["near"]]
    assert len(set(pairs)) == 4 * len(cells) and all((d, c) in set(pairs) and c != d for c, d in pairs)
    at = {r["c"]: (r["m"]["lat"], r["m"]["lon"]) for r in rows}
    ends = spark.createDataFrame([(*at[c], *at[d]) for c, d in pairs], "a double, b double, c double, d double")
    away = np.array([r[0] for r in ends.select(haversine_nm("a", "b", "c", "d")).collect()])
    assert away.max() < 2 * away.min()  # neighbours across a face's edge are as near as those within one


def test_odd_points(spark):
    odd = spark.createDataFrame([(90.0, 0.0), (90.0, 123.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (45.0, 45.0), (None, 1.0), (35.26438968275466, 45.0)], "lat double, lon double")
    cells = [r[0] for r in odd.select(sphere_cell("lat", "lon", 6)).collect()]
    assert cells[6] is None and None not in cells[:6] and cells[3] == cells[4] or abs(cells[3] - cells[4]) < 2**31


def bronze(spark, reports):
    rows = spark.createDataFrame([(r,) for r in reports], "report_json string")
    return envelopes.with_variant(rows)


def test_types_widen_over_loads(spark):
    one = bronze(spark, ['{"hex": "a", "n": 1, "w": {"x": 1}, "k": 5, "z": null}', '{"n": 2, "l": [1]}', "not json", None])
    two = bronze(spark, ['{"n": 2.5, "w": {"x": 2, "y": "t"}, "k": "five", "l": [1.5], "z": true}'])
    first = envelopes.register_fields({}, one)
    assert {n: t.simpleString() for n, t in first.items()} == {"n": "bigint", "w": "struct<x:bigint>", "k": "bigint", "l": "array<bigint>", "z": "string"}
    second = envelopes.register_fields(first, two)
    assert {n: t.simpleString() for n, t in second.items()} == {"n": "double", "w": "struct<x:bigint,y:string>", "k": "variant", "l": "array<double>", "z": "variant"}
    rows = envelopes.evolved(one.unionByName(two), second).select("n", "w.x", "w.y", F.col("k").cast("string").alias("k"), "l").collect()
    assert [tuple(r) for r in rows] == [(1.0, 1, None, "5", None), (2.0, None, None, None, [1.0]), (None,) * 5, (None,) * 5, (2.5, 2, "t", "five", [1.5])]
    assert envelopes.register_fields(second, one) == second


def test_merged_types():
    whole, real, text = T.LongType(), T.DoubleType(), T.StringType()
    assert envelopes.merged_type(whole, real) == real and envelopes.merged_type(text, whole) == T.VariantType()
    a = T.StructType([T.StructField("b", whole), T.StructField("c", text)])
    b = T.StructType([T.StructField("a", text), T.StructField("b", real)])
    assert envelopes.merged_type(a, b).simpleString() == "struct<a:string,b:double,c:string>" == envelopes.merged_type(b, a).simpleString()
