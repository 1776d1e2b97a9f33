"""Small hand-made tables."""

from pyspark.sql import functions as F

EPOCH = 1704067200

SILVER = ("icao string, callsign string, registration string, ac_type string, apt_icao string, snapshot_ts timestamp, lat double,"
          " lon double, alt_ft int, alt_geom_ft int, gs_kt double, track_deg double, sel_altitude_ft int, squawk string, emergency string,"
          " has_position boolean, dist_to_apt_nm double, bearing_to_apt double, heading_err_deg double, vertical_rate_fpm double,"
          " vertical_rate_src string, is_grounded boolean, phase string")


def silver(spark, rows):
    """Reports from dicts; `t` is seconds after the epoch of the fixtures."""
    base = dict(icao="a1", callsign="DAL1", registration="N1", ac_type="B738", apt_icao="KATL", lat=33.7, lon=-84.5, alt_ft=3000,
                alt_geom_ft=3050, gs_kt=180.0, track_deg=90.0, sel_altitude_ft=None, squawk="1200", emergency="none", has_position=True,
                dist_to_apt_nm=10.0, bearing_to_apt=90.0, heading_err_deg=5.0, vertical_rate_fpm=-500.0, vertical_rate_src="baro",
                is_grounded=False, phase="descent")
    names = [c.split()[0] for c in SILVER.split(", ")]
    data = []
    for r in rows:
        full = base | r
        data.append(tuple(None if n == "snapshot_ts" else full[n] for n in names) + (float(full["t"]),))
    df = spark.createDataFrame(data, SILVER + ", t double")
    return df.withColumn("snapshot_ts", F.timestamp_micros(((F.lit(EPOCH) + F.col("t")) * 1e6).cast("bigint"))).drop("t")


def collected(df, *columns, order=None):
    rows = df.select(*columns).collect()
    return sorted((tuple(r) for r in rows), key=repr) if order is None else [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]
