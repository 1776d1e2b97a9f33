"""Fixed values the results depend on, kept together and in natural order."""

# Mean Earth radius in nautical miles, used by every great-circle distance.
EARTH_RADIUS_NM = 3440.065

# The airport the fixtures describe: code, latitude, longitude, field elevation (ft).
AIRPORT = "KATL"
AIRPORT_LAT = 33.6407
AIRPORT_LON = -84.4277
FIELD_ELEV_FT = 1026

# Acceptance rate of the airport, arrivals per hour.
ACCEPTANCE_PER_HOUR = 90

# Special transponder codes and the event text of each.
SQUAWK_EVENTS = {
    "7500": "Unlawful interference / hijack (7500)",
    "7600": "Radio failure (7600)",
    "7700": "General emergency (7700)",
}

# Emergency field values that count as an emergency, and the event text of each.
EMERGENCY_EVENTS = {
    "lifeguard": "Lifeguard / medical flight",
    "minfuel": "Minimum fuel",
    "nordo": "No radio (NORDO)",
    "unlawful": "Unlawful interference",
    "downed": "Aircraft downed",
    "general": "General emergency (flag)",
}

# Point-wise flight phases, in model order.
PHASES = ["ground", "climb", "descent", "cruise", "level", "unknown"]

# Wide-body and heavy type codes.
HEAVY_TYPES = [
    "A124", "A332", "A333", "A338", "A339", "A342", "A343", "A345", "A346", "A359", "A35K", "A388",
    "B742", "B744", "B748", "B762", "B763", "B764", "B772", "B773", "B778", "B779", "B77L", "B77W",
    "B788", "B789", "B78X", "C17", "C5M", "IL76", "MD11",
]

# Model inputs, in the order a model is fitted on.
ETA_FEATURES = [
    "dist_to_apt_nm", "heading_err_deg", "bearing_sin", "bearing_cos", "alt_ft", "gs_kt",
    "vrate_fpm", "closure_kt", "closure_geom_kt", "turn_rate_dps", "sel_altitude_ft",
    "airport_inbound_count", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_heavy", "phase",
]
ETA_LABEL = "minutes_to_touchdown"

# Inputs of the hold-risk classifier.
HOLD_FEATURES = [
    "dist_to_apt_nm", "alt_ft", "gs_kt", "vrate_fpm", "heading_err_deg", "closure_kt",
    "turn_rate_dps", "bearing_to_apt", "naive_eta_min", "hour_utc", "dow", "airport_inbound_count",
]

# Evaluation bands by distance, right-closed: label and upper bound in nm.
DISTANCE_BANDS = [("0-20nm", 20.0), ("20-40nm", 40.0), ("40-70nm", 70.0), ("70-100nm", 101.0)]

# Demand grid.
BINS_PER_DAY = 96
HORIZON_BINS = 12
BACKTEST_CUTS = (32, 44, 56, 68, 80)

# Forecast quantiles with the standard normal score of each.
QUANTILE_Z = [
    (0.1, -1.2815515655446004),
    (0.2, -0.8416212335729143),
    (0.3, -0.5244005127080407),
    (0.4, -0.2533471031357997),
    (0.5, 0.0),
    (0.6, 0.2533471031357997),
    (0.7, 0.5244005127080407),
    (0.8, 0.8416212335729143),
    (0.9, 1.2815515655446004),
]

# Weights of the recent level in the first bins of the blended forecast.
BLEND_WEIGHTS = (0.6, 0.35, 0.15)

# Population-stability cut-offs.
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25

# Ordered failure classes: the first class with a matching text wins.
FAILURE_TEXTS = [
    ("auth", ["invalid_grant", "refresh token is invalid", "permission_denied", "unauthorized",
              "403", "does not have permission"]),
    ("transient", ["internal_error", "transient", "retry the run", "temporarily unavailable",
                   "request_limit_exceeded", "too many requests", "429", "could not reach driver",
                   "connection reset", "service unavailable", "503"]),
    ("data", ["not ready: ", "no rows", "min old", "table or view not found", "table_or_view_not_found"]),
    ("code", ["traceback", "error:", "exception", "keyerror", "valueerror", "typeerror",
              "attributeerror", "nameerror", "assertionerror", "runtimeerror"]),
]
