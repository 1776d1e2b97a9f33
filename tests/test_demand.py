import numpy as np
import pytest
from helpers import EPOCH, collected
from pyspark.sql import functions as F

from glidepath.constants import QUANTILE_Z
from glidepath.operators import demand


def landings(spark, per_day):
    """per_day: list of {slot: count}, one dict per day."""
    rows = [(EPOCH + d * 86400 + s * 900 + i,) for d, slots in enumerate(per_day) for s, n in slots.items() for i in range(n)]
    return spark.createDataFrame(rows, "s bigint").select(F.lit("KATL").alias("apt_icao"), F.timestamp_seconds("s").alias("touchdown_ts"))


@pytest.mark.parametrize("n,bins", [(19, 0), (20, 96)])
def test_active_day_threshold(spark, n, bins):
    assert demand.demand_series(landings(spark, [{40: n}])).count() == bins


def frame(spark, seed, days=9):
    rng = np.random.default_rng(seed)
    data = rng.poisson(3, (days, 96))
    return data.astype(float), demand.day_frame(demand.demand_series(landings(
        spark, [{s: int(n) for s, n in enumerate(row) if n} for row in data])))


def test_backtest_matches_numpy(spark):
    data, fr = frame(spark, 4)
    got = {(r.cut, (r.date.toordinal() - 738886), r.model): r for r in demand.backtest(fr).collect()}
    days, dow = len(data), [i % 7 for i in range(len(data))]
    for d in range(days):
        ref = [x for x in range(days) if x != d]
        alike = [x for x in ref if dow[x] == dow[d]] or ref
        for cut in (32, 44, 56, 68, 80):
            actual, ctx = data[d, cut:cut + 12], data[d, :cut]
            clim, cdow = data[ref].mean(0)[cut:cut + 12], data[alike].mean(0)[cut:cut + 12]
            w = np.array([0.6, 0.35, 0.15] + [0] * 9)
            level = ctx[0]
            for y in ctx[1:]:
                level = 0.3 * y + 0.7 * level
            preds = {"climatological_mean": clim, "climatological_dow": cdow, "seasonal_naive": data[ref[-1], cut:cut + 12],
                     "context_mean": np.full(12, ctx[-8:].mean()), "blended": (1 - w) * cdow + w * ctx[-4:].mean(),
                     "exp_smoothing": np.full(12, level)}
            naive = np.abs(actual - preds["seasonal_naive"]).mean()
            for model, p in preds.items():
                r = got[(cut, d, model)]
                assert r.mae == pytest.approx(np.abs(actual - p).mean())
                assert r.mase == pytest.approx(r.mae / naive)
            q = np.clip(np.stack([clim + z * np.sqrt(np.maximum(clim, 1)) for _, z in QUANTILE_Z], 1), 0, None)
            loss = np.mean([np.maximum(p * (actual - q[:, i]), (p - 1) * (actual - q[:, i])).sum() for i, (p, _) in enumerate(QUANTILE_Z)])
            assert got[(cut, d, "climatological_mean")].wql == pytest.approx(2 * loss / max(actual.sum(), 1))


def test_mase_is_null_on_an_exact_naive_forecast(spark):
    one = {s: 1 for s in range(96)}
    fr = demand.day_frame(demand.demand_series(landings(spark, [one, one])))
    assert demand.backtest(fr).where("mase IS NOT NULL").count() == 0


def test_forecast_needs_four_context_bins(spark):
    _, fr = frame(spark, 2, 3)
    asked = spark.createDataFrame([("KATL", 3), ("KATL", 4)], "series string, current_slot int").withColumns({
        "date": F.lit("2024-01-02").cast("date"), "arrivals_so_far": F.lit(1.0), "scored_at": F.current_timestamp()})
    out = demand.forecast(asked, demand.profile(fr))
    assert out.count() == 12
    assert out.where("predicted_q10 > predicted_q50 OR predicted_q50 > predicted_q90 OR predicted_q10 < 0").count() == 0


def test_profile_falls_back_to_all_days(spark):
    _, fr = frame(spark, 3, 2)  # a Monday and a Tuesday
    asked = spark.createDataFrame([("KATL", 40, 2), ("KATL", 40, 5)], "series string, slot int, dow int")
    got = dict(collected(demand.expected(asked, demand.profile(fr)), "dow", "mean"))
    ys = [r.y for r in fr.where("slot = 40").orderBy("date").collect()]
    assert got[2] == ys[0] and got[5] == pytest.approx(sum(ys) / 2)
