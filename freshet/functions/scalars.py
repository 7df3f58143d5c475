"""Scalar column expressions of the measurement pipeline. Columns may be given by name or as expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088

# Molar mass in g/mol and charge of the six target ions.
ION_KEYS = ("cl", "na", "ca", "mg", "so4", "alk")
ION_WEIGHTS = {"cl": (35.45, 35.45), "na": (22.99, 22.99), "ca": (40.078, 20.039), "mg": (24.305, 12.1525), "so4": (96.06, 48.03), "alk": (100.09, 50.04)}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    la, lb = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def parse_number(text) -> Column:
    """Plain decimal text as a double; anything else (suffix letters, separators, NaN, blank) gives null."""
    t = F.trim(_c(text).cast("string"))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def parse_datetime(text, *formats: str) -> Column:
    """First of the formats that reads the text, as a timestamp without zone; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)).cast("timestamp_ntz") for f in formats])


def standard_ion(name) -> Column:
    """Ion key of a determinand name; adsorption ratios and carbonates of calcium are not ions; null when none fits."""
    # The texts that name an ion, and their order.
    n = F.lower(F.trim(_c(name)))
    return (
        F.when(n.contains("alkalinity"), "alk")
        .when(n.rlike("^(sulfate|sulphate)") | (n == "so4"), "so4")
        .when(n.startswith("chloride") | (n == "cl"), "cl")
        .when(n.rlike(r"^sodium\b") & ~n.contains("adsorption"), "na")
        .when(n.rlike(r"^calcium\b") & ~n.contains("carbonate"), "ca")
        .when(n.rlike(r"^magnesium\b"), "mg")
    )


def fraction_class(name, fallback: str = "unknown", fix_unfiltered: bool = False) -> Column:
    """dissolved, total or ``fallback``. By default a text holding "filtered" is dissolved even within "unfiltered"; ``fix_unfiltered`` tests the latter first."""
    n = F.lower(_c(name))
    total = n.contains("total") | n.contains("unfiltered") | n.contains("recoverable")
    dissolved = n.contains("dissolved") | n.contains("filtered") | n.contains("filterable")
    out = F.when(n.contains("unfiltered"), "total") if fix_unfiltered else F.when(F.lit(False), F.lit(None).cast("string"))
    return F.coalesce(out.when(dissolved, "dissolved").when(total, "total"), F.lit(fallback))


# Unit texts understood by the plain converter, after trimming and lower-casing.
UNIT_NAMES = {
    "mg/l": "mg/L", "milligram per liter": "mg/L", "ppm": "mg/L", "ug/l": "ug/L", "µg/l": "ug/L", "ppb": "ug/L",
    "meq/l": "meq/L", "mmol/l": "mmol/L", "mol/m3": "mol/m3", "mol/m^3": "mol/m3",
}


def unit_name(unit) -> Column:
    """Standard name of a unit text; an unknown one passes through trimmed; null becomes the empty text."""
    t = F.trim(_c(unit))
    out = F.when(_c(unit).isNull(), "")
    for text, name in UNIT_NAMES.items():
        out = out.when(F.lower(t) == text, name)
    return out.otherwise(t)


def unit_factor(unit, ion) -> Column:
    """Factor to mg/L of a standard unit for an ion; null when unsupported."""
    u, i = unit_name(unit), _c(ion)
    pick = lambda k: F.coalesce(*[F.when(i == key, F.lit(w[k])) for key, w in ION_WEIGHTS.items()])
    known = i.isin(*ION_KEYS)
    return F.when(known & (u == "mg/L"), F.lit(1.0)).when(known & (u == "ug/L"), F.lit(1e-3)).when(u == "meq/L", pick(1)).when(u.isin("mmol/L", "mol/m3"), pick(0))


def is_below(flag, value, limit) -> Column:
    """True when the marker says below detection, or the value is missing and a limit is given."""
    # Markers of readings below detection.
    mark = F.coalesce(F.trim(_c(flag)), F.lit("")).isin("<", "ND", "BDL", "U", "<=")
    return mark | (_c(value).isNull() & _c(limit).isNotNull())


def season(ts) -> Column:
    """winter (DJF), summer (JJA) or other, by calendar month."""
    m = F.month(_c(ts))
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(6, 7, 8), "summer").otherwise("other")


def clip(x, low=None, high=None) -> Column:
    """Bounded value; null stays null (greatest and least alone would skip it)."""
    c = _c(x)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def safe_ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def bounded_ratio(a, b, low: float, high: float) -> Column:
    """Clipped a / b in which a positive number over 0 takes the upper bound and 0 / 0 stays null."""
    return F.when((_c(b) == 0) & (_c(a) > 0), F.lit(high)).otherwise(clip(safe_ratio(a, b), low, high))


def block_id(lat, lon, degrees: float = 2.0) -> Column:
    """Spatial block ``row_column`` of a square lattice."""
    return F.concat_ws("_", F.floor(_c(lat) / degrees).cast("string"), F.floor(_c(lon) / degrees).cast("string"))


def percent_per_year(slope) -> Column:
    return F.expm1(_c(slope)) * 100


def project(base, slope, base_year, target_year: int = 2050) -> Column:
    """base * exp(slope * years ahead)."""
    return _c(base) * F.exp(_c(slope) * (F.lit(target_year) - _c(base_year)))


def project_policy(base, slope, base_year, factor: float, policy_start: int = 2025, target_year: int = 2050) -> Column:
    """Growth at ``slope`` up to the policy start (none when the base is later), then at ``slope * factor`` up to the target year."""
    before = F.lit(policy_start) - F.least(_c(base_year), F.lit(policy_start))
    return _c(base) * F.exp(_c(slope) * before + _c(slope) * factor * (target_year - policy_start))


def shift_climate(temp, precip, pet, d_temp, d_precip, pet_sensitivity: float = 0.02) -> dict[str, Column]:
    """Shifted temp_c, precip_mm, pet_mm and aridity (precipitation over PET, floored at 1)."""
    p, e = _c(precip) + _c(d_precip), _c(pet) * (1 + pet_sensitivity * _c(d_temp))
    return {"temp_c": _c(temp) + _c(d_temp), "precip_mm": p, "pet_mm": e, "aridity": p / F.when(e.isNotNull(), F.greatest(e, F.lit(1.0)))}


def iso_to_month_first(day) -> Column:
    """YYYY-MM-DD text as MM-DD-YYYY."""
    return F.date_format(F.to_date(_c(day)), "MM-dd-yyyy")


def safe_name(text, length: int = 60) -> Column:
    """Letters and digits kept, all else an underscore, cut to ``length``."""
    return F.substring(F.regexp_replace(_c(text), r"[^\p{L}\p{N}]", "_"), 1, length)


def plain_dashes(text) -> Column:
    """En and em dashes as hyphens."""
    return F.translate(_c(text), "–—", "--")


def calendar_windows(first_day, last_day) -> Column:
    """Array of structs ``start, end``: the calendar years between two days, the first and last cut to them; null or crossed days give none."""
    a, b = F.to_date(_c(first_day)), F.to_date(_c(last_day))
    years = F.when(a <= b, F.sequence(F.year(a), F.year(b)))
    return F.transform(years, lambda y: F.struct(F.greatest(a, F.make_date(y, F.lit(1), F.lit(1))).alias("start"), F.least(b, F.make_date(y, F.lit(12), F.lit(31))).alias("end")))


def yearly_precipitation(flux) -> Column:
    """Millimetres a year of a precipitation flux in kg per square metre and second."""
    return _c(flux) * (86400 * 365)


# Factors from the raw units of covariates to those used (tenths, tenths a month, months); shares of land cover become per cent.
COVARIATE_SCALES = {"temp_c": 0.1, "pet_mm": 1.2, "pr_tc_mm": 12.0, "soil_ph": 0.1}


def scaled_covariates(columns: list[str]) -> list[Column]:
    """The columns in order, those with another raw unit scaled to the one in use."""
    factor = lambda c: 100.0 if c.startswith("lc_") else COVARIATE_SCALES.get(c)
    return [(F.col(c) * factor(c)).alias(c) if factor(c) else F.col(c) for c in columns]


def albers(lat, lon) -> tuple[Column, Column]:
    """(x, y) in metres of the equal-area conic map of North America: GRS 80, parallels 20 and 60 degrees, origin 40 N 96 W."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    area = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    scale = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
    q = lambda d: area(math.sin(math.radians(d)))
    n = (scale(20) ** 2 - scale(60) ** 2) / (q(60) - q(20))
    c = scale(20) ** 2 + n * q(20)
    s = F.sin(F.radians(_c(lat)))
    here = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * here) / n, n * F.radians(_c(lon) + 96)
    return rho * F.sin(theta), a * math.sqrt(c - n * q(40)) / n - rho * F.cos(theta)
