"""Registered queries over the driver's tables, one or more for each operator family, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions import tensors
from framegrid.functions.fields import BSPLINE, DISPLACEMENT, DisplacementFieldTransform, field_map
from framegrid.functions.transforms import (
    AffineTransform,
    GeodeticToCartesian,
    SphericalToCartesian,
    compose,
    coordinate_system_change,
    transform_frame,
)
from framegrid.operators.diagnostics import axis_statistics, jacobian_determinant_report, round_trip_residual_report
from framegrid.operators.framed import FramedDF, frame_columns, frame_table
from framegrid.operators.resample import resample
from framegrid.plans.anatomy import patient_coordinate_system
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid, pos

FILL = -1.0
_SYSTEM = CoordinateSystem(("x", "y"), ("1", "1"))
PLANE = ReferenceFrame.declared("framegrid", "price-plane", _SYSTEM)
ANGLE = math.radians(10)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The price surface: mean log price by quantity (1 to 50) and discount (0 to 10 hundredths) --------------


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass with map-side aggregation: 550 cells whatever the table's size."""
    q, d = (F.col("l_quantity") - 1).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(q.alias("pos_q"), d.alias("pos_d")).agg(F.avg(F.ln("l_extendedprice")).alias("value"))


SURFACE_SQL = """cells as (select cast(l_quantity - 1 as bigint) as pos_q, cast(round(l_discount * 100) as bigint) as pos_d,
  avg(ln(l_extendedprice)) as value from lineitem group by 1, 2)"""


def surface_grid(offset: float | None = 0.5) -> Grid:
    source = ArrayCoordinates(("q", "d"), ("1", "1"), sample_offset=(offset, offset))
    t = AffineTransform.from_matrix(np.eye(2), source=source, target=PLANE, translation=[0, 0])
    return Grid(t, {"q": ("q", np.arange(1, 51)), "d": ("d", np.arange(11))})


def oblique_grid(nu: int = 40, nv: int = 8) -> Grid:
    c, s = 0.9 * math.cos(ANGLE), 0.9 * math.sin(ANGLE)
    source = ArrayCoordinates(("u", "v"), ("1", "1"), sample_offset=(0.5, 0.5))
    t = AffineTransform.from_matrix([[c, -s], [s, c]], source=source, target=PLANE, translation=[5, 1])
    return Grid(t, {"u": ("u", np.arange(nu)), "v": ("v", np.arange(nv))})


def _oblique_sql(nu: int = 40, nv: int = 8) -> str:
    c, s = 0.9 * math.cos(ANGLE), 0.9 * math.sin(ANGLE)
    return f"""target as (select u.range as pos_u, v.range as pos_v,
  {c!r}::double * u.range + {-s!r}::double * v.range + 4.0::double as p,
  {s!r}::double * u.range + {c!r}::double * v.range + 1.0::double as r from range({nu}) u, range({nv}) v)"""


def _linear_sql(low: float = -1e-9, before: float = 0.0) -> str:
    return f"""
with {SURFACE_SQL}, {_oblique_sql()},
placed as (select *, p >= {low - before} and p <= 49 - {low - before} and r >= {low - before} and r <= 10 - {low - before} as inside,
  least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from target),
corners as (select *, floor(cp) as ip, floor(cr) as ir, cp - floor(cp) as fp, cr - floor(cr) as fr from placed)
select pos_u, pos_v, round(case when inside then
  (1 - fp) * (1 - fr) * a.value + fp * (1 - fr) * coalesce(b.value, 0) + (1 - fp) * fr * coalesce(c.value, 0) + fp * fr * coalesce(d.value, 0)
  else {FILL} end, 4) as value
from corners t left join cells a on a.pos_q = ip and a.pos_d = ir left join cells b on b.pos_q = ip + 1 and b.pos_d = ir
left join cells c on c.pos_q = ip and c.pos_d = ir + 1 left join cells d on d.pos_q = ip + 1 and d.pos_d = ir + 1
"""


def resample_linear_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(surface(spark, sf_dir), surface_grid(), oblique_grid(), fill_value=FILL)
    return out.select("pos_u", "pos_v", F.round("value", 4).alias("value"))


def resample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(surface(spark, sf_dir), surface_grid(), oblique_grid(), fill_value=FILL, domain="cells")
    return out.select("pos_u", "pos_v", F.round("value", 4).alias("value"))


def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(surface(spark, sf_dir), surface_grid(), oblique_grid(), fill_value=FILL, method="nearest")
    return out.select("pos_u", "pos_v", F.round("value", 4).alias("value"))


def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(surface(spark, sf_dir), surface_grid(), oblique_grid(), fill_value=FILL, method="cubic")
    return out.select("pos_u", "pos_v", F.round("value", 4).alias("value"))


def _prefilter_sql(n: int, name: str) -> str:
    """The spline's filter along a line of n mirrored samples as a matrix: (c[k-1] + 4 c[k] + c[k+1]) / 6 = v[k]."""
    m = (np.eye(n) * 4 + np.eye(n, k=1) + np.eye(n, k=-1)) / 6
    m[0, 0] = m[-1, -1] = 5 / 6
    rows = ", ".join("[" + ", ".join(f"{x!r}" for x in row) + "]" for row in np.linalg.inv(m).tolist())
    return f"{name} as (select a.range as i, b.range as k, ([{rows}]::double[][])[a.range + 1][b.range + 1] as m from range({n}) a, range({n}) b)"


def _cubic_sql() -> str:
    return f"""
with {SURFACE_SQL}, {_oblique_sql()}, {_prefilter_sql(50, "fq")}, {_prefilter_sql(11, "fd")},
cq as (select fq.i as pos_q, pos_d, sum(m * value) as value from fq join cells on cells.pos_q = fq.k group by 1, 2),
cc as (select pos_q, fd.i as pos_d, sum(m * value) as value from fd join cq on cq.pos_d = fd.k group by 1, 2),
placed as (select *, p >= -1e-9 and p <= 49 + 1e-9 and r >= -1e-9 and r <= 10 + 1e-9 as inside, least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from target),
b as (select *, floor(cp) as i, floor(cr) as j, {_basis_sql("(cp - floor(cp))")} as bp, {_basis_sql("(cr - floor(cr))")} as br from placed),
s as (select pos_u, pos_v, any_value(inside) as inside, sum(bp[s.range + 1] * br[t.range + 1] * value) as v from b, range(4) s, range(4) t, cc
  where cc.pos_q = least(greatest(i - 1 + s.range, 0), 49) and cc.pos_d = least(greatest(j - 1 + t.range, 0), 10) group by 1, 2)
select pos_u, pos_v, round(case when inside then v else {FILL} end, 4) as value from s
"""


NEAREST_SQL = f"""
with {SURFACE_SQL}, {_oblique_sql()}
select pos_u, pos_v, round(case when p >= -1e-9 and p <= 49 + 1e-9 and r >= -1e-9 and r <= 10 + 1e-9 then value else {FILL} end, 4) as value
from target left join cells on pos_q = floor(least(greatest(p, 0), 49) + 0.5) and pos_d = floor(least(greatest(r, 0), 10) + 0.5)
"""


def resample_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a displacement field that covers a part of the target; the rest is filled, not an error."""
    moved = ReferenceFrame.declared("framegrid", "moved-plane", _SYSTEM)
    t = AffineTransform.from_matrix(np.diag([10.0, 3.0]), source=ArrayCoordinates(("a", "b"), ("1", "1")), target=moved, translation=[0, 0])
    nodes = Grid(t, {"a": ("a", np.arange(4)), "b": ("b", np.arange(3))})
    a, b = np.meshgrid(np.arange(4.0), np.arange(3.0), indexing="ij")
    field = DisplacementFieldTransform(nodes, np.stack([0.5 * a, 0.25 * b - 0.1], -1), target=PLANE)
    base = oblique_grid()
    target = Grid(base.transform.with_endpoints(target=moved), {"u": ("u", np.arange(40)), "v": ("v", np.arange(8))})
    out = resample(surface(spark, sf_dir), surface_grid(), target, transform=field, fill_value=FILL)
    return out.select("pos_u", "pos_v", F.round("value", 4).alias("value"))


def _field_sql() -> str:
    inner = _linear_sql().split("placed as")[1]
    return f"""
with {SURFACE_SQL}, {_oblique_sql().replace("target as", "asked as")},
target as (select pos_u, pos_v, p + 0.05 * (p + 1) as p, r + 0.25 * r / 3 - 0.1 as r from asked where p + 1 >= 0 and p + 1 < 30 and r >= 0 and r < 6),
placed as{inner.rsplit("from corners t", 1)[0]} from corners t {inner.rsplit("from corners t", 1)[1]}
union all select pos_u, pos_v, {FILL}::double from asked where not (p + 1 >= 0 and p + 1 < 30 and r >= 0 and r < 6)
"""


def same_grid_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reversed, shifted and transposed window: values are copied, nothing is interpolated."""
    source = ArrayCoordinates(("a", "b"), ("1", "1"), sample_offset=(0.5, 0.5))
    t = AffineTransform.from_matrix([[0, -1], [1, 0]], source=source, target=PLANE, translation=[48, 2])
    target = Grid(t, {"a": ("a", np.arange(12)), "b": ("b", np.arange(50))})
    out = resample(surface(spark, sf_dir), surface_grid(), target, fill_value=FILL)
    return out.select("pos_a", "pos_b", F.round("value", 4).alias("value"))


SAME_GRID_SQL = f"""
with {SURFACE_SQL}
select a.range as pos_a, b.range as pos_b, round(case when 47 - b.range between 0 and 49 and a.range + 2 between 0 and 10 then value else {FILL} end, 4) as value
from range(12) a cross join range(50) b left join cells on pos_q = 47 - b.range and pos_d = a.range + 2
"""


# Missing values: an hourly axis of events with gaps -------------------------------------------------

HOURS = 720
TIME = ReferenceFrame.declared("framegrid", "event-hours", CoordinateSystem(("t",), ("h",)))


def _hour_of_month():
    """Whole hours since 1970, modulo 720; from date and hour, so no time zone is involved."""
    return F.pmod(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts"), F.lit(HOURS)).cast("long")


def hour_grid(n: int, first: float, step: float = 1.0, name: str = "h") -> Grid:
    source = ArrayCoordinates((name,), ("1",), sample_offset=(0.5,))
    t = AffineTransform.from_matrix([[step]], source=source, target=TIME, translation=[first])
    return Grid(t, {name: (name, np.arange(n))})


def resample_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of root values by event type at half-hour steps: an hour without events is missing, not zero."""
    events = read(spark, sf_dir, "events")
    hourly = events.groupBy("event_type", _hour_of_month().alias("pos_h")).agg(F.avg(F.sqrt(F.abs("value"))).alias("value"))
    target = hour_grid(900, -10.25, 0.85, "g")
    out = resample(hourly, hour_grid(HOURS, 0.0), target, carried=["event_type"], fill_value=FILL)
    return out.select("pos_g", "event_type", F.isnan("value").alias("missing"), F.round(F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.col("value")), 4).alias("value"))


MISSING_SQL = f"""
with hourly as (select event_type, ((epoch_us(ts) // 3600000000) % 720 + 720) % 720 as h, avg(sqrt(abs(value))) as value from events group by 1, 2),
target as (select range as pos_g, 0.85::double * range + (-10.25)::double as p from range(900)),
placed as (select *, p >= -1e-9 and p <= 719 + 1e-9 as inside, least(greatest(p, 0), 719) as cp from target),
c as (select *, floor(cp) as i, cp - floor(cp) as f from placed),
w as (select pos_g, k.event_type, inside,
  case when f < 1 then 1 - f else 0 end * coalesce(a.value, 0) + f * coalesce(b.value, 0) as v,
  case when a.value is null then 1 - f else 0 end + case when b.value is null then f else 0 end as gone
  from c cross join (select distinct event_type from hourly) k
  left join hourly a on a.h = i and a.event_type = k.event_type left join hourly b on b.h = i + 1 and b.event_type = k.event_type)
select pos_g, event_type, inside and gone > 1e-9 as missing,
  round(case when not inside then {FILL} when gone > 1e-9 then 0 else v end, 4) as value from w
"""


# Point maps ------------------------------------------------------------------------------------------

SPACE = CoordinateSystem(("x", "y", "z"), ("mm",) * 3)
SCANNER = ReferenceFrame.declared("framegrid", "scanner", SPACE)


def affine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ArrayCoordinates(("q", "d", "t"), ("1",) * 3)
    first = AffineTransform.from_matrix([[0.5, 0, 1], [0, 2, 0], [1, 0, -1]], source=source, target=SCANNER, translation=[1, 2, 3])
    moved = SCANNER.with_coordinate_system(CoordinateSystem(("a", "b", "c"), ("mm",) * 3))
    second = AffineTransform.from_matrix([[0, 1, 0], [1, 0, 0], [0, 0, 2]], source=SCANNER, target=moved, translation=[0.25, 0, -1])
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    out = transform_frame(rows, compose(first, second))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in "abc"])


AFFINE_SQL = """
select l_orderkey, l_linenumber, round(2 * l_discount + 2.25, 9) as a, round(0.5 * l_quantity + l_tax + 1, 9) as b,
  round(2 * l_quantity - 2 * l_tax + 5, 9) as c from lineitem
"""


def system_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    lps = ReferenceFrame.declared("framegrid", "patient", patient_coordinate_system("LPS", "mm", axes=("l", "p", "s")))
    ras = lps.with_coordinate_system(patient_coordinate_system("SRA", "mm", axes=("s2", "r2", "a2")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("l"), F.col("l_discount").alias("p"), F.col("l_tax").alias("s"))
    return transform_frame(rows, coordinate_system_change(lps, ras)).select("l_orderkey", "l_linenumber", "s2", "r2", "a2")


SYSTEM_SQL = "select l_orderkey, l_linenumber, l_tax as s2, -l_quantity as r2, -l_discount as a2 from lineitem"


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = oblique_grid().to_df(spark, points=True)
    return out.select("pos_u", "pos_v", "u", "v", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


GRID_POINTS_SQL = f"""
with {_oblique_sql()} select pos_u, pos_v, pos_u::double as u, pos_v::double as v, round(p + 1, 9) as x, round(r, 9) as y from target
"""

#: Uneven labels of a time axis, in days (fixed values of this query).
LABELS = [0.0, 31.0, 59.0, 90.0, 120.0, 151.0, 181.0, 212.0, 243.0, 273.0, 304.0, 334.0, 365.0]


def uneven_grid() -> Grid:
    days = ReferenceFrame.declared("framegrid", "days", CoordinateSystem(("day",), ("d",)))
    t = AffineTransform.from_matrix([[1.0]], source=ArrayCoordinates(("m",), ("d",)), target=days, translation=[0])
    return Grid(t, {"m": ("m", np.array(LABELS))})


def positions_at_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = oblique_grid()
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    at = grid.position_columns([F.col("x"), F.col("y")])
    placed = rows.withColumns(at)
    return placed.select("l_orderkey", "l_linenumber", *[F.round(F.when(F.isnan(d), F.lit(-99.0)).otherwise(F.col(d)), 6).alias(d) for d in ("u", "v")])


def _uniform_sql() -> str:
    g = oblique_grid().transform.inverse()
    (a, b), (c, d) = g.matrix.tolist()
    s, t = g.translation.tolist()
    return f"""
with p as (select l_orderkey, l_linenumber, {a!r}::double * l_quantity + {b!r}::double * (l_discount * 100) + {s!r}::double as u,
  {c!r}::double * l_quantity + {d!r}::double * (l_discount * 100) + {t!r}::double as v from lineitem),
q as (select *, u >= -1e-9 and u <= 39 + 1e-9 and v >= -1e-9 and v <= 7 + 1e-9 as inside from p)
select l_orderkey, l_linenumber, round(case when inside then least(greatest(u, 0), 39) else -99 end, 6) as u,
  round(case when inside then least(greatest(v, 0), 7) else -99 end, 6) as v from q
"""


def positions_at_nonuniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.expr("pmod(datediff(cast(l_shipdate as date), date '1992-01-01'), 400)").cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", days.alias("day"))
    p = uneven_grid().position_columns([F.col("day")])["m"]
    return rows.select("l_orderkey", "l_linenumber", F.round(F.when(F.isnan(p), F.lit(-99.0)).otherwise(p), 6).alias("m"))


NONUNIFORM_SQL = f"""
with axis as (select unnest({LABELS}::double[]) as v, unnest(range({len(LABELS)})) as i),
brackets as (select v as lo, lead(v) over (order by v) as hi, i from axis),
d as (select l_orderkey, l_linenumber, ((date_diff('day', date '1992-01-01', cast(l_shipdate as date)) % 400) + 400) % 400::double as day from lineitem)
select l_orderkey, l_linenumber, round(coalesce(case when day = 365 then 12.0::double else i + (day - lo) / (hi - lo) end, -99), 6) as m
from d left join brackets on (day >= lo and day < hi) or (day = 365 and hi = 365)
"""


def points_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("l_quantity") / 50 * 12).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    (day,) = uneven_grid().point_columns({"m": F.col("p")})
    return rows.select("l_orderkey", "l_linenumber", F.round(day, 6).alias("day"))


POINTS_AT_SQL = f"""
with p as (select l_orderkey, l_linenumber, l_quantity / 50 * 12 as p from lineitem),
q as (select *, least(greatest(floor(p), 0), 11)::int as i from p)
select l_orderkey, l_linenumber, round((1 - (p - i)) * ({LABELS}::double[])[i + 1] + (p - i) * ({LABELS}::double[])[i + 2], 6) as day from q
"""


# Charts ----------------------------------------------------------------------------------------------

EARTH = ReferenceFrame.declared("framegrid", "earth", CoordinateSystem(("lon", "lat", "h"), ("deg", "deg", "m"), representation="geodetic", axis_roles=("longitude", "latitude", "height")))
ECEF = EARTH.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("m",) * 3))
CHART = GeodeticToCartesian(EARTH, ECEF)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 360 - 180).cast("double").alias("lon"),
        (F.col("l_suppkey") % 179 - 89).cast("double").alias("lat"), (F.col("l_quantity") * 100).alias("h"),
    )


_A, _F = 6378137.0, 1 / 298.257223563
_B2 = (1 - _F) ** 2
_PLACES_SQL = f"""p as (select l_orderkey, l_linenumber, (l_partkey % 360 - 180)::double as lon, (l_suppkey % 179 - 89)::double as lat,
  l_quantity * 100 as h from lineitem),
n as (select *, {_A} / sqrt(cos(radians(lat)) * cos(radians(lat)) + {_B2!r}::double * sin(radians(lat)) * sin(radians(lat))) as n from p),
e as (select *, (n + h) * cos(radians(lat)) * cos(radians(lon)) as x, (n + h) * cos(radians(lat)) * sin(radians(lon)) as y,
  (n * {_B2!r}::double + h) * sin(radians(lat)) as z from n)"""


def geodetic_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform_frame(_places(spark, sf_dir), CHART)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 3).alias(c) for c in "xyz"])


def ecef_to_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = CHART.inverse()
    there = transform_frame(_places(spark, sf_dir), CHART).drop("lon", "lat", "h")
    out = transform_frame(there, back)
    return out.select("l_orderkey", "l_linenumber", F.round(F.pmod(F.round("lon", 6), F.lit(360.0)), 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("h", 3).alias("h"))


ECEF_SQL = f"with {_PLACES_SQL} select l_orderkey, l_linenumber, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from e"
GEODETIC_SQL = """
select l_orderkey, l_linenumber, ((l_partkey % 360 - 180 + 360) % 360)::double as lon, (l_suppkey % 179 - 89)::double as lat, round(l_quantity * 100, 3) as h
from lineitem
"""


def lon_lat_grid(nlon: int = 36, nlat: int = 18) -> Grid:
    globe = ReferenceFrame.declared("framegrid", "globe", CoordinateSystem(("lon", "lat"), ("deg", "deg"), representation="spherical", axis_roles=("longitude", "latitude")))
    t = AffineTransform.from_matrix(np.eye(2), source=ArrayCoordinates(("lon", "lat"), ("deg", "deg"), sample_offset=(0.5, 0.5)), target=globe, translation=[0, 0])
    return Grid(t, {"lat": ("lat", np.linspace(-85, 85, nlat)), "lon": ("lon", np.arange(nlon) * (360 / nlon))})


def _globe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 36).alias("pos_lon"), F.pmod(F.col("l_suppkey") + F.col("l_linenumber"), F.lit(18)).cast("long").alias("pos_lat"), "l_extendedprice")
    cells = rows.groupBy("pos_lat", "pos_lon").agg(F.avg(F.ln("l_extendedprice")).alias("value"))
    full = lon_lat_grid().to_df(spark, coordinates=False).join(cells, ["pos_lat", "pos_lon"], "left")
    return full.select("pos_lat", "pos_lon", F.coalesce("value", F.lit(0.0)).alias("value"))


def _fine(lats: np.ndarray, lons: np.ndarray) -> Grid:
    base = lon_lat_grid()
    return Grid(base.transform, {"lat": ("lat", lats), "lon": ("lon", lons)})


_GLOBE_SQL = """cells as (select l_partkey % 36 as i, (l_suppkey + l_linenumber) % 18 as j, avg(ln(l_extendedprice)) as value from lineitem group by 1, 2),
globe as (select j.range as j, i.range as i, coalesce(value, 0) as value from range(18) j cross join range(36) i left join cells on cells.i = i.range and cells.j = j.range)"""


def seam_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across the meridian where longitudes begin anew."""
    target = _fine(np.linspace(-80, 80, 21), np.arange(90) * 7.0 - 200.0)
    return resample(_globe(spark, sf_dir), lon_lat_grid(), target, fill_value=FILL).select("pos_lat", "pos_lon", F.round("value", 4).alias("value"))


SEAM_SQL = f"""
with {_GLOBE_SQL},
target as (select a.range as pos_lat, b.range as pos_lon, (a.range * 8.0 - 80 + 85) / 10 as r, (((b.range * 7 - 200) % 360 + 360) % 360) / 10.0::double as p from range(21) a, range(90) b),
c as (select *, least(floor(r), 16)::bigint as j, floor(p)::bigint as i from target), w as (select *, r - j as fr, p - i as fp from c)
select pos_lat, pos_lon, round((1 - fr) * (1 - fp) * g.value + (1 - fr) * fp * h.value + fr * (1 - fp) * k.value + fr * fp * l.value, 4) as value from w
join globe g on g.j = w.j and g.i = w.i join globe h on h.j = w.j and h.i = (w.i + 1) % 36
join globe k on k.j = w.j + 1 and k.i = w.i join globe l on l.j = w.j + 1 and l.i = (w.i + 1) % 36
"""


def pole_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that go on across the poles, where the neighbour lies on the opposite meridian."""
    target = _fine(np.array([-90.0, -88.0, -86.0, 84.0, 86.5, 89.0]), np.arange(72) * 5.0)
    return resample(_globe(spark, sf_dir), lon_lat_grid(), target, fill_value=FILL).select("pos_lat", "pos_lon", F.round("value", 4).alias("value"))


POLE_SQL = f"""
with {_GLOBE_SQL},
lats as (select unnest([-90.0, -88.0, -86.0, 84.0, 86.5, 89.0]::double[]) as lat, unnest(range(6)) as pos_lat),
wide as (select j, i, value from globe union all select -1, (i + 18) % 36, value from globe where j = 0 union all select 18, (i + 18) % 36, value from globe where j = 17),
target as (select pos_lat, range as pos_lon, (lat + 85) / 10 as r, range * 0.5::double as p from lats cross join range(72)),
c as (select *, floor(r)::bigint as j, floor(p)::bigint as i, r - floor(r) as fr, p - floor(p) as fp from target)
select pos_lat, pos_lon, round((1 - fr) * (1 - fp) * g.value + (1 - fr) * fp * h.value + fr * (1 - fp) * k.value + fr * fp * l.value, 4) as value from c
join wide g on g.j = c.j and g.i = c.i join wide h on h.j = c.j and h.i = (c.i + 1) % 36
join wide k on k.j = c.j + 1 and k.i = c.i join wide l on l.j = c.j + 1 and l.i = (c.i + 1) % 36
"""


# Framed tables -----------------------------------------------------------------------------------------


def framed(spark: SparkSession, sf_dir: str) -> FramedDF:
    return frame_table(surface(spark, sf_dir), surface_grid())


def _rounded(df: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    return df.select(*keys, *[F.round(v, 4).alias(v) for v in values or ["value"]])


def isel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framed(spark, sf_dir).isel(q=slice(45, 3, -3), d=[7, 2])
    return _rounded(out.df, ["pos_q", "pos_d", "q", "d"])


ISEL_SQL = f"""with {SURFACE_SQL} select ((45 - pos_q) // 3)::bigint as pos_q, case pos_d when 7 then 0 else 1 end::bigint as pos_d, (pos_q + 1)::double as q, pos_d::double as d,
  round(value, 4) as value from cells where pos_q between 4 and 45 and (45 - pos_q) % 3 = 0 and pos_d in (7, 2)"""


def sel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framed(spark, sf_dir).sel(q=[7.3, 30.8], method="nearest").sel(d=slice(2, 6))
    return _rounded(out.df, ["pos_q", "pos_d", "q", "d"])


SEL_SQL = f"""with {SURFACE_SQL} select case pos_q when 6 then 0 else 1 end::bigint as pos_q, pos_d - 2 as pos_d, (pos_q + 1)::double as q, pos_d::double as d,
  round(value, 4) as value from cells where pos_q in (6, 30) and pos_d between 2 and 6"""


def align_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = framed(spark, sf_dir)
    return _rounded((a.isel(q=slice(5, 30)) - a.isel(q=slice(20, 50), d=slice(0, 4))).df, ["pos_q", "pos_d", "q", "d"])


ALIGN_INNER_SQL = f"""with {SURFACE_SQL} select pos_q - 20 as pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, 0.0::double as value from cells
  where pos_q between 20 and 29 and pos_d < 4"""


def align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = framed(spark, sf_dir)
    left, right, _ = a.isel(q=slice(0, 5), d=slice(0, 3)).align(a.isel(q=slice(3, 8), d=slice(2, 6)), "outer")
    v = F.when(F.isnan("value"), F.lit(FILL)).otherwise(F.col("value"))
    return left.df.select("pos_q", "pos_d", "q", "d", F.round(v, 4).alias("value"))


ALIGN_OUTER_SQL = f"""with {SURFACE_SQL}, labels as (select a.range as pos_q, b.range as pos_d from range(8) a, range(6) b)
select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(coalesce(case when pos_q < 5 and pos_d < 3 then value end, {FILL}), 4) as value
from labels left join cells using (pos_q, pos_d)"""


def arith_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table times a plain table of rates by discount label, which inherits the geometry."""
    rates = read(spark, sf_dir, "lineitem").groupBy(F.round(F.col("l_discount") * 100).alias("d")).agg(F.avg("l_tax").alias("rate"))
    return _rounded((framed(spark, sf_dir) * rates).df, ["pos_q", "pos_d", "q", "d"])


ARITH_SQL = f"""with {SURFACE_SQL}, rates as (select round(l_discount * 100) as d, avg(l_tax) as rate from lineitem group by 1)
select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(value * rate, 4) as value from cells join rates on rates.d = pos_d"""


def reduce_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(framed(spark, sf_dir).mean("d"), ["pos_q", "q"])


REDUCE_SQL = f"with {SURFACE_SQL} select pos_q, (pos_q + 1)::double as q, round(avg(value), 4) as value from cells group by 1, 2"


def _by_status(spark: SparkSession, sf_dir: str) -> FramedDF:
    q, d = (F.col("l_quantity") - 1).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    rows = read(spark, sf_dir, "lineitem").groupBy(q.alias("pos_q"), d.alias("pos_d"), "l_returnflag").agg(F.sum("l_extendedprice").alias("value"))
    return frame_table(rows, surface_grid(), carried=["l_returnflag"])


def reduce_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_by_status(spark, sf_dir).sum("l_returnflag").df, ["pos_q", "pos_d", "q", "d"])


REDUCE_CARRIED_SQL = """select cast(l_quantity - 1 as bigint) as pos_q, cast(round(l_discount * 100) as bigint) as pos_d, l_quantity as q, round(l_discount * 100) as d,
  round(sum(l_extendedprice), 4) as value from lineitem group by 1, 2, 3, 4"""


def resample_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each return flag is a surface of its own; targets outside have a row for each."""
    out = _by_status(spark, sf_dir).resample_to(oblique_grid(), fill_value=FILL, method="nearest")
    v = F.when(F.isnan("value"), F.lit(0.0)).otherwise(F.col("value"))
    return out.df.select("pos_u", "pos_v", "l_returnflag", F.round(v, 4).alias("value"))


CARRIED_SQL = f"""
with cells as (select cast(l_quantity - 1 as bigint) as pos_q, cast(round(l_discount * 100) as bigint) as pos_d, l_returnflag, sum(l_extendedprice) as value
  from lineitem group by 1, 2, 3), {_oblique_sql()}
select pos_u, pos_v, k.l_returnflag, round(case when p >= -1e-9 and p <= 49 + 1e-9 and r >= -1e-9 and r <= 10 + 1e-9 then coalesce(value, 0) else {FILL} end, 4) as value
from target cross join (select distinct l_returnflag from cells) k left join cells on cells.l_returnflag = k.l_returnflag
and pos_q = floor(least(greatest(p, 0), 49) + 0.5) and pos_d = floor(least(greatest(r, 0), 10) + 0.5)
"""


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framed(spark, sf_dir).rolling(q=4).df
    return out.select("pos_q", "pos_d", F.round(F.when(F.isnan("value"), F.lit(FILL)).otherwise(F.col("value")), 4).alias("value"))


ROLLING_SQL = f"""with {SURFACE_SQL} select pos_q, pos_d, round(case when count(*) over w = 4 then avg(value) over w else {FILL} end, 4) as value from cells
  window w as (partition by pos_d order by pos_q rows between 3 preceding and current row)"""


def shift_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framed(spark, sf_dir).shift(q=3).roll(d=4).df
    return out.select("pos_q", "pos_d", "q", "d", F.round(F.when(F.isnan("value"), F.lit(FILL)).otherwise(F.col("value")), 4).alias("value"))


SHIFT_SQL = f"""with {SURFACE_SQL} select a.pos_q, (a.pos_d + 4) % 11 as pos_d, (a.pos_q + 1)::double as q, ((a.pos_d + 4) % 11)::double as d, round(coalesce(b.value, {FILL}), 4) as value
  from cells a left join cells b on b.pos_q = a.pos_q - 3 and b.pos_d = a.pos_d"""


def bind_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions attached to a plain table by its coordinate labels."""
    sizes = read(spark, sf_dir, "part").groupBy("p_size").agg(F.avg(F.ln("p_retailprice")).alias("value"))
    t = AffineTransform.from_matrix([[2.0]], source=ArrayCoordinates(("p_size",), ("1",)), target=TIME, translation=[1.0])
    out = frame_columns(sizes, t, ascending=False).frame_coordinates()
    return out.df.select("pos_p_size", "p_size", "t", F.round("value", 4).alias("value"))


BIND_SQL = """select (row_number() over (order by p_size desc) - 1)::bigint as pos_p_size, p_size, (2 * p_size + 1)::double as t, round(avg(ln(p_retailprice)), 4) as value
  from part group by p_size"""


# Boxes ---------------------------------------------------------------------------------------------------

#: Cells of the source axis, with a gap and an overlap, and target cells (fixed values of these queries).
SLABS = [(0.0, 10.0), (10.0, 18.0), (20.0, 30.0), (28.0, 40.0), (40.0, 50.0)]
BINS = [(0.0, 5.0), (5.0, 12.0), (15.0, 25.0), (25.0, 35.0), (30.0, 50.0), (45.0, 60.0)]


def _slab_grid(cells: list[tuple[float, float]], name: str) -> Grid:
    line = ReferenceFrame.declared("framegrid", "line", CoordinateSystem(("s",), ("1",)))
    t = AffineTransform.from_matrix([[1.0]], source=ArrayCoordinates((name,), ("1",), sample_offset=(0.5,)), target=line, translation=[0])
    c = np.array(cells)
    return Grid(t, {name: (name, c.mean(axis=1))}, intervals={name: c})


def _slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.least(F.floor((F.col("l_quantity") - 1) / 10), F.lit(4)).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(part.alias("pos_slab")).agg(F.avg(F.ln("l_extendedprice")).alias("value"))


def box_overlap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(_slabs(spark, sf_dir), _slab_grid(SLABS, "slab"), _slab_grid(BINS, "bin"), method="overlap_mean", support="average", fill_value=FILL, return_coverage=True)
    return out.select("pos_bin", F.round("value", 4).alias("value"), F.round("coverage", 9).alias("coverage"))


def box_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the bins' middles: all cells that hold the point, edges included, in equal parts."""
    out = resample(_slabs(spark, sf_dir), _slab_grid(SLABS, "slab"), _slab_grid(BINS, "bin"), method="overlap_mean", fill_value=FILL)
    return out.select("pos_bin", F.round("value", 4).alias("value"))


def _rows_sql(cells: list[tuple[float, float]]) -> str:
    return ", ".join(f"({k}, {lo}::double, {hi}::double)" for k, (lo, hi) in enumerate(cells))


_SLABS_SQL = f"""means as (select least(floor((l_quantity - 1) / 10), 4)::bigint as k, avg(ln(l_extendedprice)) as value from lineitem group by 1),
slab as (select k, lo, hi, value from (values {_rows_sql(SLABS)}) s(k, lo, hi) join means using (k)), bin as (select * from (values {_rows_sql(BINS)}) b(j, lo, hi))"""
BOX_SQL = f"""
with {_SLABS_SQL},
edge as (select lo as e from slab union select hi from slab union select lo from bin union select hi from bin),
seg as (select e as a, lead(e) over (order by e) as b from edge),
cov as (select a, b, count(slab.k) as n from seg left join slab on lo <= a and hi >= b where b is not null group by 1, 2),
part as (select j, cov.a, cov.b, n, (cov.b - cov.a) as len from bin join cov on cov.a >= bin.lo and cov.b <= bin.hi and n > 0),
tot as (select j, sum(len) as covered from part group by 1),
mean as (select part.j, sum(len / n * value) / any_value(covered) as value from part join slab on slab.lo <= part.a and slab.hi >= part.b join tot on tot.j = part.j group by 1)
select bin.j::bigint as pos_bin, round(case when coalesce(covered, 0) / (hi - lo) >= 0.5 then value else {FILL} end, 4) as value, round(coalesce(covered, 0) / (hi - lo), 9) as coverage
from bin left join tot on tot.j = bin.j left join mean on mean.j = bin.j
"""
BOX_POINT_SQL = f"""
with {_SLABS_SQL}
select j::bigint as pos_bin, round(coalesce(avg(value), {FILL}), 4) as value from bin left join slab on (bin.lo + bin.hi) / 2 between slab.lo and slab.hi group by 1
"""


def box_average_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of root event values averaged over uneven bins of time, by event type."""
    events = read(spark, sf_dir, "events")
    hourly = events.groupBy("event_type", _hour_of_month().alias("pos_h")).agg(F.sum(F.sqrt(F.abs("value"))).alias("value"))
    full = hour_grid(HOURS, 0.0).to_df(spark, coordinates=False).crossJoin(events.select("event_type").distinct()).join(hourly, ["pos_h", "event_type"], "left")
    full = full.withColumn("value", F.coalesce("value", F.lit(0.0)))
    source = ArrayCoordinates(("h",), ("h",), sample_offset=(0.0,))
    t = AffineTransform.from_matrix([[1.0]], source=source, target=TIME, translation=[0])
    h = np.arange(HOURS, dtype=float)
    edges = np.cumsum(np.arange(0, 37)) * 1.0
    bins = np.stack([edges[:-1], edges[1:]], 1)
    hours = Grid(t, {"h": ("h", h)}, intervals={"h": np.stack([h, h + 1], 1)})
    s2 = ArrayCoordinates(("bin",), ("h",), sample_offset=(0.5,))
    target = Grid(AffineTransform.from_matrix([[1.0]], source=s2, target=TIME, translation=[0]), {"bin": ("bin", bins.mean(1))}, intervals={"bin": bins})
    out = resample(full, hours, target, method="step", support="average", carried=["event_type"], fill_value=FILL)
    return out.select("pos_bin", "event_type", F.round("value", 4).alias("value"))


BOX_EVENTS_SQL = f"""
with hourly as (select event_type, ((epoch_us(ts) // 3600000000) % 720 + 720) % 720 as h, sum(sqrt(abs(value))) as value from events group by 1, 2),
bin as (select range as j, range * (range + 1) / 2 as lo, (range + 1) * (range + 2) / 2 as hi from range(36))
select j as pos_bin, k.event_type, round(case when least(hi, 720) - least(lo, 720) >= 0.5 * (hi - lo) then coalesce(sum(value), 0) / (least(hi, 720) - lo) else {FILL} end, 4) as value
from bin cross join (select distinct event_type from events) k left join hourly on hourly.event_type = k.event_type and h >= lo and h < hi group by j, lo, hi, k.event_type
"""


# Tensors ---------------------------------------------------------------------------------------------------

_BASIS = [[0.0, 2.0, 0.0], [-1.0, 0.0, 0.5], [0.0, 0.0, 4.0]]


def tensor_vector_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    made = {"c": tensors.VECTOR, "w": tensors.COVECTOR, "p": tensors.CROSS_PRODUCT_PSEUDOVECTOR}
    out = rows.withColumns({k: tensors.tensor_columns(F.col("v"), _BASIS, t) for k, t in made.items()})
    return out.select("vec_id", *[F.round(F.col(k)[i], 6).alias(f"{k}{i}") for k in made for i in range(3)])


def _tensor_sql() -> str:
    j = np.array(_BASIS)
    it, det = np.linalg.inv(j).T, np.linalg.det(j)
    cols = []
    for k, m in (("c", j), ("w", it), ("p", it * np.sign(det) * abs(det))):
        for i in range(3):
            cols.append("round(" + " + ".join(f"{float(m[i, n])!r}::double * embedding[{n + 1}]::double" for n in range(3)) + f", 6) as {k}{i}")
    return f"select vec_id, {', '.join(cols)} from embeddings"


def tensor_sym_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer products of vectors, packed by Mandel's rule, unpacked again and their traces."""
    e = lambda i: F.col("embedding")[i].cast("double")
    full = F.array(*[F.array(*[e(i) * e(k) for k in range(3)]) for i in range(3)])
    packing = tensors.SymmetricPacking.mandel()
    rows = read(spark, sf_dir, "embeddings").select("vec_id", full.alias("full")).withColumn("packed", packing.pack(F.col("full")))
    back = packing.unpack(F.col("packed"))
    return rows.select("vec_id", *[F.round(F.col("packed")[i], 6).alias(f"m{i}") for i in range(6)], F.round(back[0][0] + back[1][1] + back[2][2], 6).alias("trace"), F.round(back[2][0], 6).alias("b20"))


PACK_SQL = f"""
with e as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)
select vec_id, round(a * a, 6) as m0, round(b * b, 6) as m1, round(c * c, 6) as m2, round(b * c * {math.sqrt(2)!r}::double, 6) as m3,
  round(a * c * {math.sqrt(2)!r}::double, 6) as m4, round(a * b * {math.sqrt(2)!r}::double, 6) as m5, round(a * a + b * b + c * c, 6) as trace, round(a * c, 6) as b20 from e
"""


def enu_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Cartesian vector written east, north, up at each place: the basis varies by row."""
    rows = _places(spark, sf_dir).withColumn("v", F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5)))
    m = tensors.EastNorthUp(EARTH).matrix([F.col("lon"), F.col("lat"), F.col("h")])
    out = rows.withColumn("enu", tensors.tensor_columns(F.col("v"), m, tensors.VECTOR))
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col("enu")[i], 6).alias(n) for i, n in enumerate(("east", "north", "up"))])


ENU_SQL = f"""
with {_PLACES_SQL}
select l_orderkey, l_linenumber, round(-sin(radians(lon)) - 2 * cos(radians(lon)), 6) as east,
  round(-sin(radians(lat)) * cos(radians(lon)) + 2 * sin(radians(lat)) * sin(radians(lon)) + 0.5 * cos(radians(lat)), 6) as north,
  round(cos(radians(lat)) * cos(radians(lon)) - 2 * cos(radians(lat)) * sin(radians(lon)) + 0.5 * sin(radians(lat)), 6) as up from p
"""


# Fields and reports ------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements in proportion to the price surface, on its own grid."""
    return surface(spark, sf_dir).select("pos_q", "pos_d", (F.col("value") / 10).alias("ux"), (-F.col("value") / 20).alias("uy"))


def _field_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500 * 0.1 + 0.35).alias("x"), (F.col("o_orderkey") % 110 * 0.1 - 0.05).alias("y"))


def displacement_field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = field_map(_field_points(spark, sf_dir), _nodes(spark, sf_dir), surface_grid(), keys=["o_orderkey"], components=["ux", "uy"], kind=DISPLACEMENT, exterior="identity")
    return out.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "inside")


def bspline_field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = field_map(_field_points(spark, sf_dir), _nodes(spark, sf_dir), surface_grid(), keys=["o_orderkey"], components=["ux", "uy"], kind=BSPLINE, exterior="identity", closed=True)
    return out.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "inside")


_FIELD_POINTS_SQL = """pts as (select *, x - 1 as p, y as r from (select o_orderkey, o_custkey % 500 * 0.1::double + 0.35::double as x,
  o_orderkey % 110 * 0.1::double - 0.05::double as y from orders))"""
FIELD_SQL = f"""
with {SURFACE_SQL}, {_FIELD_POINTS_SQL},
c as (select *, p >= -0.5 and p < 49.5 and r >= -0.5 and r < 10.5 as inside, least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from pts),
w as (select *, least(floor(cp), 48) as i, least(floor(cr), 9) as j, cp - least(floor(cp), 48) as fp, cr - least(floor(cr), 9) as fr from c),
v as (select w.*, (1 - fp) * (1 - fr) * a.value + fp * (1 - fr) * b.value + (1 - fp) * fr * d.value + fp * fr * e.value as v from w
  join cells a on a.pos_q = i and a.pos_d = j join cells b on b.pos_q = i + 1 and b.pos_d = j join cells d on d.pos_q = i and d.pos_d = j + 1 join cells e on e.pos_q = i + 1 and e.pos_d = j + 1)
select o_orderkey, round(case when inside then x + v / 10 else x end, 6) as x, round(case when inside then y - v / 20 else y end, 6) as y, inside from v
"""


def _basis_sql(f: str) -> str:
    return f"[(1 - {f}) ** 3 / 6, (4 - 6 * {f} * {f} + 3 * {f} ** 3) / 6, (4 - 6 * (1 - {f}) ** 2 + 3 * (1 - {f}) ** 3) / 6, {f} ** 3 / 6]"


BSPLINE_SQL = f"""
with {SURFACE_SQL}, {_FIELD_POINTS_SQL},
c as (select *, p >= 1 and p <= 48 and r >= 1 and r <= 9 as inside, least(greatest(p, 1), 48) as cp, least(greatest(r, 1), 9) as cr from pts),
w as (select *, greatest(least(floor(cp), 47), 1) as i, greatest(least(floor(cr), 8), 1) as j from c),
b as (select *, {_basis_sql("(cp - i)")} as bp, {_basis_sql("(cr - j)")} as br from w),
v as (select o_orderkey, any_value(x) as x, any_value(y) as y, any_value(inside) as inside, sum(bp[s.range + 1] * br[t.range + 1] * value) as v
  from b, range(4) s, range(4) t, cells where pos_q = i - 1 + s.range and pos_d = j - 1 + t.range group by 1)
select o_orderkey, round(case when inside then x + v / 10 else x end, 6) as x, round(case when inside then y - v / 20 else y end, 6) as y, inside from v
"""


def jacobian_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jacobian_determinant_report(_places(spark, sf_dir), SphericalToCartesian(_SPHERE, _BALL), ["lon", "lat", "h"])
    return out.select("n", F.round("minimum", 6).alias("minimum"), F.round("folded_fraction", 9).alias("folded_fraction"))


_SPHERE = ReferenceFrame.declared("framegrid", "ball", CoordinateSystem(("lon", "lat", "r"), ("deg", "deg", "m"), representation="spherical", axis_roles=("longitude", "latitude", "radius")))
_BALL = _SPHERE.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("m",) * 3))
JACOBIAN_SQL = """
with d as (select (l_quantity * 100) ** 2 * cos(radians((l_suppkey % 179 - 89)::double)) * radians(1) * radians(1) as det from lineitem)
select count(*) as n, round(min(det), 6) as minimum, round(avg(case when det <= 0 then 1.0 else 0.0 end), 9) as folded_fraction from d
"""


def round_trip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affine map and an inverse that is off by a stated amount."""
    a = AffineTransform.from_matrix([[2, 0, 0], [0, 1, 0.5], [0, 0, 1]], source=SCANNER, target=_MOVED, translation=[1, 0, 0])
    b = AffineTransform.from_matrix([[0.5, 0, 0], [0, 1, -0.5], [0, 0, 1]], source=_MOVED, target=SCANNER, translation=[-0.5, 0.125, 0])
    b = AffineTransform.from_matrix(b.matrix * [[1.01], [1], [1]], source=_MOVED, target=SCANNER, translation=b.translation)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    out = round_trip_residual_report(rows, a, b)
    return out.select("n", F.round("maximum", 6).alias("maximum"), F.round("rms", 6).alias("rms"))


_MOVED = ReferenceFrame.declared("framegrid", "moved", SPACE)
ROUND_TRIP_SQL = """
with r as (select sqrt((0.505 * (2 * l_quantity + 1) - 0.5 - l_quantity) ** 2 + 0.125 ** 2) as d from lineitem)
select count(*) as n, round(max(d), 6) as maximum, round(sqrt(avg(d * d)), 6) as rms from r
"""


def axis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, ends and least and greatest step of a long axis, without bringing it to the driver."""
    days = F.expr("datediff(cast(o_orderdate as date), date '1992-01-01')").cast("double")
    return axis_statistics(read(spark, sf_dir, "orders").select(days.alias("day")), "day").withColumn("deviation", F.round("deviation", 6))


AXIS_SQL = """
with d as (select distinct date_diff('day', date '1992-01-01', cast(o_orderdate as date))::double as v from orders), s as (select v, v - lag(v) over (order by v) as step from d)
, e as (select count(*) as n, min(v) as first, max(v) as last, min(step) as least_step, max(step) as greatest_step from s),
r as (select v, row_number() over (order by v) - 1 as k from d)
select n, first, last, least_step, greatest_step, round((select max(abs(v - (first + k * (last - first) / (n - 1)))) from r), 6) as deviation from e
"""

_ALL: list[tuple[Callable[[SparkSession, str], DataFrame], str | None]] = [
    (resample_linear_2d, _linear_sql()), (resample_cells, _linear_sql(before=0.5)), (resample_nearest, NEAREST_SQL), (resample_cubic, _cubic_sql()),
    (resample_field, _field_sql()),
    (same_grid_gather, SAME_GRID_SQL), (resample_missing, MISSING_SQL), (resample_carried, CARRIED_SQL), (affine_map, AFFINE_SQL), (system_change, SYSTEM_SQL),
    (grid_points, GRID_POINTS_SQL), (positions_at_uniform, _uniform_sql()), (positions_at_nonuniform, NONUNIFORM_SQL), (points_at, POINTS_AT_SQL),
    (geodetic_to_ecef, ECEF_SQL), (ecef_to_geodetic, GEODETIC_SQL), (seam_linear, SEAM_SQL), (pole_linear, POLE_SQL), (isel_slice, ISEL_SQL), (sel_nearest, SEL_SQL),
    (align_inner, ALIGN_INNER_SQL), (align_outer, ALIGN_OUTER_SQL), (arith_mixed, ARITH_SQL), (reduce_geometry, REDUCE_SQL), (reduce_carried, REDUCE_CARRIED_SQL),
    (rolling_mean, ROLLING_SQL), (shift_roll, SHIFT_SQL), (bind_columns, BIND_SQL), (box_overlap_mean, BOX_SQL), (box_point, BOX_POINT_SQL),
    (box_average_events, BOX_EVENTS_SQL), (tensor_vector_change, _tensor_sql()), (tensor_sym_pack, PACK_SQL), (enu_components, ENU_SQL),
    (displacement_field_map, FIELD_SQL), (bspline_field_map, BSPLINE_SQL), (jacobian_report, JACOBIAN_SQL), (round_trip_report, ROUND_TRIP_SQL), (axis_report, AXIS_SQL),
]


def _every() -> list[tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from framegrid import file_queries, format_queries, space_queries

    return [*_ALL, *space_queries.ALL, *format_queries.ALL, *file_queries.ALL]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _every()}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _every() if sql is not None}


__all__ = ["oracle_sql", "pos", "queries"]
