"""Column functions: radar geometry and phase, optical indices, quality bits, dates, quantisation, text ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two wavelengths in use, overpass times, season months, valid and invalid scene classes.
WAVELENGTH_MM = 55.465763
ISBAS_WAVELENGTH_M = 0.0555465763
OVERPASS = {"ascending": "16:36", "descending": "05:09"}
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}
SCL_VALID = (4, 5, 6, 7)
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)


def rad_to_los_mm(phase: Column, wavelength_mm: float = WAVELENGTH_MM) -> Column:
    return phase * (wavelength_mm / (4 * math.pi))


def los_to_vertical(los: Column, incidence_deg: Column) -> Column:
    return los / F.cos(F.radians(incidence_deg))


def los_from_vertical(dh: Column, incidence_deg: Column) -> Column:
    return dh * F.cos(F.radians(incidence_deg))


def incidence_deg(lv_theta: Column) -> Column:
    return F.degrees(math.pi / 2 - lv_theta)


def los_enu(lv_theta: Column, lv_phi: Column) -> tuple[Column, Column, Column]:
    return F.cos(lv_theta) * F.cos(lv_phi), F.cos(lv_theta) * F.sin(lv_phi), F.sin(lv_theta)


def los_unit_vector(incidence: Column, heading: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a right-looking sensor's line of sight, from the ground to the sensor."""
    i, h = F.radians(incidence), F.radians(heading)
    return -F.sin(i) * F.cos(h), F.sin(i) * F.sin(h), F.cos(i)


def two_los(asc: Column, desc: Column, ga: tuple[Column, Column], gd: tuple[Column, Column]) -> tuple[Column, Column]:
    """(east, up) of two lines of sight by Cramer's rule; null where they are parallel."""
    det = ga[0] * gd[1] - ga[1] * gd[0]
    return F.try_divide(asc * gd[1] - ga[1] * desc, det), F.try_divide(ga[0] * desc - asc * gd[0], det)


def cycle_risk(dlos_mm: Column, wavelength_mm: float = WAVELENGTH_MM) -> Column:
    return F.abs(dlos_mm) > wavelength_mm / 4


def crb_sigma_mm(coh: Column, looks: float, floor_mm: float = 0.0, wavelength_mm: float = WAVELENGTH_MM) -> Column:
    """Phase noise of a coherence by the Cramer-Rao bound, in mm, with a floor added in quadrature."""
    c = F.least(F.greatest(coh, F.lit(0.01)), F.lit(0.999))
    s = F.sqrt((1 - c * c) / (2 * looks * c * c)) * (wavelength_mm / (4 * math.pi))
    return F.sqrt(s * s + floor_mm * floor_mm)


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when((a + b) != 0, (a - b) / (a + b))


def optical_indices(b: dict[str, Column], scl: Column) -> dict[str, Column]:
    """NDVI, NDRE, NDMI, NDWI and MNDWI where the scene class is valid and both bands are above 0; ``snow`` is class 11."""
    ok = scl.isin(*SCL_VALID)

    def index(x: Column, y: Column) -> Column:
        return F.when(ok & (x > 0) & (y > 0), (x - y) / (x + y))

    return {"ndvi": index(b["B08"], b["B04"]), "ndre": index(b["B8A"], b["B05"]), "ndmi": index(b["B8A"], b["B11"]), "ndwi": index(b["B03"], b["B08"]), "mndwi": index(b["B03"], b["B11"]), "valid": ok, "snow": scl == 11}


def qa_clear(qa: Column) -> Column:
    """No fill, cloud, cirrus, shadow or snow bit (the lowest six); a missing value is not clear."""
    return F.coalesce(qa, F.lit(1)).bitwiseAND(F.lit(63)) == 0


def db_to_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def power_to_db(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(power))


def rvi(vv: Column, vh: Column) -> Column:
    """Radar vegetation index of powers."""
    return F.try_divide(4 * vh, vv + vh)


def overpass_utc(date: Column, track: Column) -> Column:
    hhmm = F.when(track == "ascending", OVERPASS["ascending"]).when(track == "descending", OVERPASS["descending"])
    return F.to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), hhmm), "yyyy-MM-dd HH:mm")


def season(date: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(F.month(date).isin(*months), name).otherwise(out)
    return out


def midpoint(t1: Column, t2: Column) -> Column:
    """The day half way between two dates, rounded down."""
    return F.date_add(t1, F.floor(F.datediff(t2, t1) / 2).cast("int"))


def datum(time: Column, breaks: list[str]) -> Column:
    """A, B, C...: how many breaks are over."""
    n = F.lit(0)
    for b in sorted(breaks):
        n = n + F.when(time >= F.lit(b).cast("timestamp"), 1).otherwise(0)
    return F.when(time.isNotNull(), F.char(65 + n))


def year_fold(t1: Column, t2: Column) -> Column:
    """The year of both ends, -1 if they differ."""
    return F.when(F.year(t1) == F.year(t2), F.year(t1)).otherwise(-1)


def years_since(t: Column, epoch: Column) -> Column:
    return (F.unix_micros(t.cast("timestamp")) - F.unix_micros(epoch.cast("timestamp"))) / (365.25 * 86400 * 1e6)


def round_to_hour(t: Column) -> Column:
    """The nearest whole hour, halves to the even one."""
    return F.timestamp_micros((F.rint(F.unix_micros(t) / 3.6e9) * 3.6e9).cast("long"))


def revisit_class(days: Column, limit: int = 9) -> Column:
    return F.when(days <= limit, "short").when(days > limit, "long")


def quantized(x: Column, low: float, high: float, levels: int = 65534, nodata: int = -32768) -> Column:
    """A number as a whole step between low and high (clipped), ``nodata`` for null."""
    step = (high - low) / levels
    return F.coalesce(F.rint((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / step).cast("int") - 32767, F.lit(nodata))


def dequantized(q: Column, low: float, high: float, levels: int = 65534, nodata: int = -32768) -> Column:
    return F.when(q != nodata, (q + 32767) * ((high - low) / levels) + low)


def pair_dates(pair: Column) -> tuple[Column, Column]:
    """The two dates of an id like 20200101_20200113; null where it is malformed."""
    ok = pair.rlike(r"^\d{8}_\d{8}$")
    return F.when(ok, F.try_to_date(F.substring(pair, 1, 8), "yyyyMMdd")), F.when(ok, F.try_to_date(F.substring(pair, 10, 8), "yyyyMMdd"))


def stamps_of_name(name: Column) -> Column:
    """old_new of the first two timestamps in a product name; null if there are fewer."""
    found = F.slice(F.regexp_extract_all(name, F.lit(r"\d{8}T\d{6}"), F.lit(0)), 1, 2)
    return F.when(F.size(found) == 2, F.array_join(F.array_sort(F.transform(found, lambda x: F.substring(x, 1, 8))), "_"))


def mixed_iso(text: Column) -> Column:
    """An ISO time with or without a fraction."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(text))


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def status_value(value: Column, status: Column) -> Column:
    """A measurement by its status code: 8 means missing, 9 means it did not occur."""
    return F.when(status == "8", None).when(status == "9", 0.0).otherwise(value)


def utm33(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 33 (WGS 84) by the Krueger series to the third order (mm within the zone)."""
    # The ellipsoid and the projection.
    a, f, k0, lon0 = 6378137.0, 1 / 298.257223563, 0.9996, 15.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: 0.5 * F.ln((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return 500_000 + k0 * big_a * east, k0 * big_a * north
