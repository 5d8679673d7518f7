"""GPS time and WGS84 / earth-centred / local coordinates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions.rotation import Vector, mat_vec, transpose

# fixed values: WGS84 ellipsoid, GPS epoch and leap seconds
SEMI_MAJOR = 6378137.0
SEMI_MINOR = 6356752.3142
FLATTENING = 1 / 298.257223563
GPS_EPOCH_S = 315964800
WEEK_S = 604800
LEAP_S = 16

E2 = FLATTENING * (2 - FLATTENING)


def gps_to_utc_us(week: Column, seconds: Column) -> Column:
    """GPS week and seconds of week to UTC microseconds."""
    return ((week * WEEK_S + seconds + GPS_EPOCH_S - LEAP_S) * 1e6).cast("bigint")


def wgs84_to_ecef(lat: Column, lon: Column, height: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = SEMI_MAJOR / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    flat = (n + height) * F.cos(phi)
    return [flat * F.cos(lam), flat * F.sin(lam), (n * (1 - E2) + height) * F.sin(phi)]


def _local_axes(lat: Column, lon: Column):
    """Rows: east, north and up at a place, in earth-centred coordinates."""
    phi, lam = F.radians(lat), F.radians(lon)
    east = [-F.sin(lam), F.cos(lam), 0]
    up = [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]
    north = [-F.sin(phi) * F.cos(lam), -F.sin(phi) * F.sin(lam), F.cos(phi)]
    return [east, north, up]


def ecef_to_enu(xyz: Vector, ref: Vector) -> list[Column]:
    """Earth-centred point to east, north, up at the reference (lat, lon, height)."""
    origin = wgs84_to_ecef(*ref)
    return mat_vec(_local_axes(ref[0], ref[1]), [a - b for a, b in zip(xyz, origin)])


def enu_to_ecef(enu: Vector, ref: Vector) -> list[Column]:
    turned = mat_vec(transpose(_local_axes(ref[0], ref[1])), enu)
    return [a + b for a, b in zip(turned, wgs84_to_ecef(*ref))]


def with_wgs84(df: DataFrame, xyz: Vector, names: Sequence[str] = ("lat", "lon", "height")) -> DataFrame:
    """Add latitude, longitude (degrees) and height of earth-centred points (Heikkinen's closed form).

    Each step is a column of its own, so that no subexpression is written out twice.
    """
    a, b = SEMI_MAJOR, SEMI_MAJOR * (1 - FLATTENING)
    second_e2 = (a * a - b * b) / (b * b)
    c = {n: F.col(f"_g_{n}") for n in ("x", "y", "z", "z2", "r2", "r", "ff", "gg", "c", "s", "k", "p", "q", "r0", "d", "u", "v", "w")}
    steps = [
        {"x": xyz[0], "y": xyz[1], "z": xyz[2]},
        {"r2": c["x"] * c["x"] + c["y"] * c["y"], "z2": c["z"] * c["z"]},
        {
            "r": F.sqrt(c["r2"]),
            "ff": 54 * b * b * c["z2"],
            "gg": c["r2"] + (1 - E2) * c["z2"] - E2 * (a * a - b * b),
        },
        {"c": E2 * E2 * c["ff"] * c["r2"] / (c["gg"] * c["gg"] * c["gg"])},
        {"s": F.cbrt(1 + c["c"] + F.sqrt(c["c"] * c["c"] + 2 * c["c"]))},
        {"k": c["s"] + 1 / c["s"] + 1},
        {"p": c["ff"] / (3 * c["k"] * c["k"] * c["gg"] * c["gg"])},
        {"q": F.sqrt(1 + 2 * E2 * E2 * c["p"])},
        {
            "r0": F.sqrt(
                a * a / 2 * (1 + 1 / c["q"]) - (1 - E2) * c["p"] * c["z2"] / (c["q"] * (1 + c["q"])) - c["p"] * c["r2"] / 2
            )
            - c["p"] * E2 * c["r"] / (1 + c["q"])
        },
        {"d": c["r"] - E2 * c["r0"]},
        {"u": F.sqrt(c["d"] * c["d"] + c["z2"]), "v": F.sqrt(c["d"] * c["d"] + (1 - E2) * c["z2"])},
        {"w": b * b / (a * c["v"])},
    ]
    out = df
    for step in steps:
        out = out.withColumns({f"_g_{n}": e for n, e in step.items()})
    lat, lon, height = names
    out = out.withColumns(
        {
            lat: F.degrees(F.atan((c["z"] + second_e2 * c["w"] * c["z"]) / c["r"])),
            lon: F.degrees(F.atan2(c["y"], c["x"])),
            height: c["u"] * (1 - c["w"]),
        }
    )
    return out.drop(*[f"_g_{n}" for n in c])


def wgs84_to_enu(lat: Column, lon: Column, height: Column, ref: Vector) -> list[Column]:
    return ecef_to_enu(wgs84_to_ecef(lat, lon, height), ref)


def with_enu_to_wgs84(df: DataFrame, enu: Vector, ref: Vector, names: Sequence[str] = ("lat", "lon", "height")) -> DataFrame:
    return with_wgs84(df, enu_to_ecef(enu, ref), names)


def wgs84_to_enu_series(lat: Column, lon: Column, height: Column, ref: Vector) -> list[Column]:
    """Second-order series around the reference; good for a few kilometres."""
    a = SEMI_MAJOR
    e2 = 1 - (SEMI_MINOR / SEMI_MAJOR) ** 2
    phi, h0 = F.radians(ref[0]), ref[2]
    d_phi, d_lam, d_h = F.radians(lat) - phi, F.radians(lon) - F.radians(ref[1]), height - h0
    sp, cp = F.sin(phi), F.cos(phi)
    root = F.sqrt(1 - e2 * sp * sp)
    prime = a / root  # radius across the meridian
    meridian = a * (1 - e2) / (root * root * root)
    east = (prime + h0) * cp * d_lam - (meridian + h0) * sp * d_phi * d_lam + cp * d_lam * d_h
    north = (
        (meridian + h0) * d_phi
        + 1.5 * a * e2 * sp * cp * d_phi * d_phi
        + sp * sp * d_h * d_phi
        + 0.5 * sp * cp * (prime + h0) * d_lam * d_lam
    )
    up = (
        d_h
        - 0.5 * (a - 1.5 * a * e2 * cp * cp + 0.5 * a * e2 + h0) * d_phi * d_phi
        - 0.5 * cp * cp * (prime - h0) * d_lam * d_lam
    )
    return [east, north, up]
