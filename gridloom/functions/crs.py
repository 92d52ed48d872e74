"""Coordinate systems in closed form: geographic WGS 84 (4326), Web Mercator (3857), UTM (326zz, 327zz), European LAEA (3035)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
F_80 = 1 / 298.257222101
RAD = math.pi / 180


class Maths:
    """The same formulas over columns and over floats."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, log, exp, asin = (F.sin, F.cos, F.tan, F.atan, F.atan2, F.sinh, F.cosh, F.asinh, F.atanh, F.sqrt, F.log, F.exp, F.asin)
    num = staticmethod(lambda v: F.lit(float(v)))
    clamp = staticmethod(lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)))
    #: let(v, f): f(v) with v computed once. Written out, the formulas would repeat their parts without bound.
    let = staticmethod(lambda v, f: F.element_at(F.transform(F.array(v), f), 1))
    pair = staticmethod(lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    parts = staticmethod(lambda p: (p["x"], p["y"]))


class Floats:
    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, log, exp, asin = (math.sin, math.cos, math.tan, math.atan, math.atan2, math.sinh, math.cosh, math.asinh, math.atanh, math.sqrt, math.log, math.exp, math.asin)
    num = staticmethod(float)
    clamp = staticmethod(lambda v: min(max(v, -1.0), 1.0))
    let = staticmethod(lambda v, f: f(v))
    pair = staticmethod(lambda x, y: (x, y))
    parts = staticmethod(lambda p: p)


def known(epsg: int) -> bool:
    return epsg in (4326, 3857, 3035) or 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760


def _check(epsg: int) -> None:
    if not known(epsg):
        raise ValueError(f"EPSG:{epsg} has no closed form here")


def _through(x, y, m, work):
    """work(x, y) -> x, y with x and y computed once."""
    return m.parts(m.let(m.pair(x, y), lambda p: m.pair(*work(*m.parts(p)))))


def forward(lon, lat, epsg: int, m=Maths):
    """Degrees to the system's x, y."""
    _check(epsg)
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return lon * m.num(A * RAD), m.num(A) * m.log(m.tan(m.num(math.pi / 4) + lat * m.num(RAD / 2)))
    return _through(lon, lat, m, lambda a, b: _laea(a, b, m) if epsg == 3035 else _utm(a, b, epsg, m))


def inverse(x, y, epsg: int, m=Maths):
    """x, y of a system to degrees."""
    _check(epsg)
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return x / m.num(A * RAD), m.atan(m.sinh(y / m.num(A))) * m.num(1 / RAD)
    return _through(x, y, m, lambda a, b: _laea_inverse(a, b, m) if epsg == 3035 else _utm_inverse(a, b, epsg, m))


def transform(x, y, source: int, target: int, m=Maths):
    if source == target:
        return x, y
    lon, lat = inverse(x, y, source, m)
    return forward(lon, lat, target, m)


def _zone(epsg: int) -> tuple[float, float]:
    return (epsg % 100) * 6 - 183.0, 0.0 if epsg < 32700 else 10_000_000.0


N = FLAT / (2 - FLAT)
RECT = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
]
E1 = 2 * math.sqrt(N) / (1 + N)


def _series(xi, eta, factors: list[float], sign: float, m):
    """xi and eta with the sines and cosines of their multiples added."""
    x, y = eta, xi
    for j, a in enumerate(factors, 1):
        k = m.num(2 * j)
        x = x + m.num(sign * a) * m.cos(k * xi) * m.sinh(k * eta)
        y = y + m.num(sign * a) * m.sin(k * xi) * m.cosh(k * eta)
    return x, y


def _utm(lon, lat, epsg: int, m):
    """Krüger's series to the sixth order."""
    lon0, north = _zone(epsg)
    d = (lon - m.num(lon0)) * m.num(RAD)
    t = m.let(m.sin(lat * m.num(RAD)), lambda s: m.sinh(m.atanh(s) - m.num(E1) * m.atanh(m.num(E1) * s)))
    angles = m.let(t, lambda t: m.pair(m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(m.num(1) + t * t))))
    x, y = m.parts(m.let(angles, lambda p: m.pair(*_series(*m.parts(p), ALPHA, 1.0, m))))
    return m.num(500_000) + m.num(0.9996 * RECT) * x, m.num(north) + m.num(0.9996 * RECT) * y


def _newton(tau, t, m):
    """One step towards the tangent of the latitude whose conformal latitude has the tangent t."""
    def step(root, tau):
        def last(sigma):
            return m.let(tau * m.sqrt(m.num(1) + sigma * sigma) - sigma * root, lambda ti: tau + (t - ti) / m.sqrt(m.num(1) + ti * ti) * (m.num(1) + m.num(1 - E1**2) * tau * tau) / (m.num(1 - E1**2) * root))

        return m.let(m.sinh(m.num(E1) * m.atanh(m.num(E1) * tau / root)), last)

    return m.let(tau, lambda tau: m.let(m.sqrt(m.num(1) + tau * tau), lambda root: step(root, tau)))


def _utm_inverse(x, y, epsg: int, m):
    lon0, north = _zone(epsg)
    start = m.pair((y - m.num(north)) / m.num(0.9996 * RECT), (x - m.num(500_000)) / m.num(0.9996 * RECT))
    angles = m.let(start, lambda p: m.pair(*_series(*m.parts(p), BETA, -1.0, m)))

    def back(p):
        b, a = m.parts(p)
        tau = m.let(m.sin(a) / m.sqrt(m.sinh(b) * m.sinh(b) + m.cos(a) * m.cos(a)), lambda t: _newton(_newton(_newton(t, t, m), t, m), t, m))
        return m.pair(m.num(lon0) + m.atan2(m.sinh(b), m.cos(a)) * m.num(1 / RAD), m.atan(tau) * m.num(1 / RAD))

    return m.parts(m.let(angles, back))


E2 = F_80 * (2 - F_80)
E3035 = math.sqrt(E2)
LAT0, LON0, FE, FN = 52 * RAD, 10.0, 4_321_000.0, 3_210_000.0


def _q(s: float) -> float:
    return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(E3035 * s) / E3035)


QP = _q(1.0)
RQ, B0 = A * math.sqrt(QP / 2), math.asin(_q(math.sin(LAT0)) / QP)
D0 = A * math.cos(LAT0) / math.sqrt(1 - E2 * math.sin(LAT0) ** 2) / (RQ * math.cos(B0))


def _laea(lon, lat, m):
    d = (lon - m.num(LON0)) * m.num(RAD)

    def project(b):
        k = m.num(RQ) * m.sqrt(m.num(2) / (m.num(1) + m.num(math.sin(B0)) * m.sin(b) + m.num(math.cos(B0)) * m.cos(b) * m.cos(d)))
        return m.let(k, lambda k: m.pair(m.num(FE) + k * m.num(D0) * m.cos(b) * m.sin(d), m.num(FN) + k * m.num(1 / D0) * (m.num(math.cos(B0)) * m.sin(b) - m.num(math.sin(B0)) * m.cos(b) * m.cos(d))))

    q = m.let(m.sin(lat * m.num(RAD)), lambda s: m.num(1 - E2) * (s / (m.num(1) - m.num(E2) * s * s) + m.atanh(m.num(E3035) * s) * m.num(1 / E3035)))
    return m.parts(m.let(m.asin(m.clamp(q * m.num(1 / QP))), project))


def _laea_inverse(x, y, m):
    u, v = (x - m.num(FE)) * m.num(1 / D0), (y - m.num(FN)) * m.num(D0)

    def back(rho):
        return m.let(m.num(2) * m.asin(m.clamp(rho * m.num(1 / (2 * RQ)))), lambda c: angles(rho, c))

    def angles(rho, c):
        lon = m.num(LON0) + m.atan2(u * m.sin(c), rho * m.num(math.cos(B0)) * m.cos(c) - v * m.num(math.sin(B0)) * m.sin(c)) * m.num(1 / RAD)
        c2, c4, c6 = E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360
        b = m.asin(m.clamp(m.cos(c) * m.num(math.sin(B0)) + v * m.sin(c) * m.num(math.cos(B0)) / rho))
        lat = m.let(b, lambda b: b + m.num(c2) * m.sin(m.num(2) * b) + m.num(c4) * m.sin(m.num(4) * b) + m.num(c6) * m.sin(m.num(6) * b))
        return m.pair(lon, lat * m.num(1 / RAD))

    return m.parts(m.let(m.sqrt(u * u + v * v) + m.num(1e-12), back))


def project_bounds(bounds: tuple[float, float, float, float], source: int, target: int, points: int = 21) -> tuple[float, float, float, float]:
    """Bounding box of a box's edge, with `points` points a side, in another system."""
    x0, y0, x1, y1 = bounds
    along = [i / (points - 1) for i in range(points)]
    edge = [(x0 + (x1 - x0) * t, y) for t in along for y in (y0, y1)] + [(x, y0 + (y1 - y0) * t) for t in along for x in (x0, x1)]
    try:
        got = [transform(x, y, source, target, Floats) for x, y in edge]
    except (ValueError, OverflowError, ZeroDivisionError) as e:
        raise ValueError(f"{bounds} can't be projected to EPSG:{target}") from e
    if not all(math.isfinite(v) for p in got for v in p):
        raise ValueError(f"{bounds} can't be projected to EPSG:{target}")
    xs, ys = zip(*got)
    return min(xs), min(ys), max(xs), max(ys)


def auto_zoom(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Web map zoom for a box in degrees: ceil(log2(360 / larger side)) within 0 .. 19."""
    side = F.greatest(east - west, north - south)
    return F.when(side <= 0, F.lit(19)).otherwise(F.least(F.greatest(F.ceil(F.log2(F.lit(360.0) / side)), F.lit(0)), F.lit(19))).cast("int")


def epsg_of_wkt(wkt: Column) -> Column:
    """The last EPSG authority code of a WKT text; an empty text is an error."""
    code = F.try_element_at(F.regexp_extract_all(wkt, F.lit(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]'), F.lit(1)), F.lit(-1))
    return F.when(F.trim(wkt) == "", F.raise_error(F.lit("an empty reference system")).cast("int")).otherwise(code.cast("int"))
