"""Registered queries over maps, fields, tensors and framed tables beyond the first set, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions import tensors
from framegrid.functions.fields import POSITION, DisplacementFieldTransform, field_map, sample_displacement_table
from framegrid.functions.transforms import (
    AffineTransform,
    SphericalToCartesian,
    compose,
    jacobian_columns_of,
    transform_frame,
)
from framegrid.operators.components import declare_components, resample_components
from framegrid.operators.diagnostics import coincidence, first_failure
from framegrid.operators.framed import FramedDF, frame_table
from framegrid.operators.resample import resample
from framegrid.plans.anatomy import orientation_codes, patient_coordinate_system, reoriented
from framegrid.plans.declare import ArrayCoordinates, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.queries import (
    _BALL,
    _FIELD_POINTS_SQL,
    _GLOBE_SQL,
    _SPHERE,
    _SYSTEM,
    FIELD_SQL,
    FILL,
    PLANE,
    SCANNER,
    SURFACE_SQL,
    _by_status,
    _field_points,
    _fine,
    _globe,
    _oblique_sql,
    framed,
    lon_lat_grid,
    oblique_grid,
    read,
    surface,
    surface_grid,
)


def _out(df: DataFrame, *keys: str, values: tuple[str, ...] = ("value",), digits: int = 4) -> DataFrame:
    missing = lambda v: F.when(F.isnan(v) | F.col(v).isNull(), F.lit(FILL)).otherwise(F.col(v))
    return df.select(*keys, *[F.round(missing(v), digits).alias(v) for v in values])


# Maps ---------------------------------------------------------------------------------------------------------


class Swirl:
    """A user's own map, in NumPy alone: it runs in Arrow batches."""

    source, target = PLANE, ReferenceFrame.declared("framegrid", "swirl", _SYSTEM)

    def transform_point(self, points):
        p = np.asarray(points, float)
        return np.stack([p[..., 0] + 0.1 * p[..., 1] ** 2, p[..., 1] - 0.5 * p[..., 0]], axis=-1)


def user_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform_frame(_field_points(spark, sf_dir), Swirl(), prefix="to_")
    return out.select("o_orderkey", F.round("to_x", 6).alias("x"), F.round("to_y", 6).alias("y"))


USER_SQL = f"with {_FIELD_POINTS_SQL} select o_orderkey, round(x + 0.1::double * y * y, 6) as x, round(y - 0.5 * x, 6) as y from pts"


def composite_chart_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees made of table columns by an affine map, then a chart, then an affine map: one expression."""
    source = ArrayCoordinates(("p", "s", "q"), ("1",) * 3)
    a = AffineTransform.from_matrix(np.diag([2.0, 0.5, 10.0]), source=source, target=_SPHERE, translation=[-180, -40, 5])
    b = AffineTransform.from_matrix([[0, 1, 0], [1, 0, 0], [0, 0, -1]], source=_BALL, target=_BALL, translation=[1, 2, 3])
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 180).alias("p"), (F.col("l_suppkey") % 160).alias("s"), F.col("l_quantity").alias("q"))
    out = transform_frame(rows, compose(a, SphericalToCartesian(_SPHERE, _BALL), b))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in "xyz"])


COMPOSITE_SQL = """with p as (select l_orderkey, l_linenumber, radians(2 * (l_partkey % 180) - 180.0::double) as lon, radians(0.5 * (l_suppkey % 160) - 40.0::double) as lat,
  10 * l_quantity + 5 as r from lineitem)
select l_orderkey, l_linenumber, round(r * cos(lat) * sin(lon) + 1, 6) as x, round(r * cos(lat) * cos(lon) + 2, 6) as y, round(3 - r * sin(lat), 6) as z from p"""


def spherical_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back through a spherical chart; longitudes come back from 0 on."""
    there = SphericalToCartesian(_SPHERE, _BALL)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 360 - 180).cast("double").alias("lon"),
                                                  (F.col("l_suppkey") % 179 - 89).cast("double").alias("lat"), F.col("l_quantity").alias("r"))
    out = transform_frame(transform_frame(rows, there).drop("lon", "lat", "r"), there.inverse())
    return out.select("l_orderkey", "l_linenumber", F.round(F.pmod(F.round("lon", 6), F.lit(360.0)), 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("r", 6).alias("r"))


SPHERICAL_SQL = """select l_orderkey, l_linenumber, ((l_partkey % 360 - 180 + 360) % 360)::double as lon, (l_suppkey % 179 - 89)::double as lat, round(l_quantity, 6) as r from lineitem"""


def affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a sheared map, taken on the driver."""
    t = AffineTransform.from_matrix([[2, 1, 0], [0, 4, 0], [0, 1, 0.5]], source=SCANNER, target=SCANNER, translation=[1, -2, 3]).inverse()
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return transform_frame(rows, t).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in "xyz"])


INVERSE_SQL = """with p as (select *, (l_discount + 2) / 4 as v from lineitem)
select l_orderkey, l_linenumber, round((l_quantity - 1 - v) / 2, 6) as x, round(v, 6) as y, round((l_tax - 3 - v) * 2, 6) as z from p"""


# Fields -------------------------------------------------------------------------------------------------------

_NODES_X, _NODES_Y = 6, 5


def _bent() -> DisplacementFieldTransform:
    """Displacements 0.5 a**2 and 0.25 b**2 at nodes (10 a, 3 b): constant slopes within each cell."""
    t = AffineTransform.from_matrix(np.diag([10.0, 3.0]), source=ArrayCoordinates(("a", "b"), ("1", "1")), target=PLANE, translation=[0, 0])
    a, b = np.meshgrid(np.arange(float(_NODES_X)), np.arange(float(_NODES_Y)), indexing="ij")
    return DisplacementFieldTransform(Grid(t, {"a": ("a", np.arange(_NODES_X)), "b": ("b", np.arange(_NODES_Y))}), np.stack([0.5 * a**2, 0.25 * b**2], -1), exterior="identity")


def field_jacobian(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jacobian_columns_of(_bent(), [F.col("x"), F.col("y")])
    out = _field_points(spark, sf_dir).withColumns({"xx": j[0][0], "xy": j[0][1], "yx": j[1][0], "yy": j[1][1]})
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("xx", "xy", "yx", "yy")])


FIELD_JACOBIAN_SQL = f"""
with {_FIELD_POINTS_SQL}, c as (select *, x >= 0 and x < 50 and y >= 0 and y < 12 as inside, least(floor(x / 10), 4) as i, least(floor(y / 3), 3) as j from pts)
select o_orderkey, round(case when inside then 1 + 0.5 * (2 * i + 1) / 10 else 1 end, 6) as xx, 0.0::double as xy, 0.0::double as yx,
  round(case when inside then 1 + 0.25 * (2 * j + 1) / 3 else 1 end, 6) as yy from c
"""


def position_field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that hold the target point itself, made of the price surface."""
    nodes = surface(spark, sf_dir).select("pos_q", "pos_d", (F.col("value") + F.col("pos_q")).alias("tx"), (F.col("value") * 2 - F.col("pos_d")).alias("ty"))
    out = field_map(_field_points(spark, sf_dir), nodes, surface_grid(), keys=["o_orderkey"], components=["tx", "ty"], kind=POSITION, exterior="identity")
    return out.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "inside")


POSITION_SQL = f"""
with {SURFACE_SQL}, {_FIELD_POINTS_SQL},
c as (select *, p >= 0 and p <= 49 and r >= 0 and r <= 10 as inside, least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from pts),
w as (select *, least(floor(cp), 48) as i, least(floor(cr), 9) as j, cp - least(floor(cp), 48) as fp, cr - least(floor(cr), 9) as fr from c),
v as (select w.*, (1 - fp) * (1 - fr) * a.value + fp * (1 - fr) * b.value + (1 - fp) * fr * d.value + fp * fr * e.value as v from w
  join cells a on a.pos_q = i and a.pos_d = j join cells b on b.pos_q = i + 1 and b.pos_d = j join cells d on d.pos_q = i and d.pos_d = j + 1 join cells e on e.pos_q = i + 1 and e.pos_d = j + 1)
select o_orderkey, round(case when inside then v + cp else x end, 6) as x, round(case when inside then 2 * v - cr else y end, 6) as y, inside from v
"""


def field_map_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way that large fields take: points joined with the nodes around them on whole positions."""
    nodes = surface(spark, sf_dir).select("pos_q", "pos_d", (F.col("value") / 10).alias("ux"), (-F.col("value") / 20).alias("uy"))
    out = field_map(_field_points(spark, sf_dir), nodes, surface_grid(), keys=["o_orderkey"], components=["ux", "uy"], exterior="identity", array_nodes=0, broadcast_nodes=0)
    return out.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "inside")


def sampled_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an affine map moves each sample of a grid by."""
    t = AffineTransform.from_matrix([[1.5, 0.25], [0, 0.5]], source=PLANE, target=PLANE, translation=[2, -1])
    out = sample_displacement_table(spark, t, oblique_grid())
    return out.select("pos_u", "pos_v", F.round("u_x", 6).alias("u_x"), F.round("u_y", 6).alias("u_y"))


SAMPLED_SQL = f"with {_oblique_sql()} select pos_u, pos_v, round(0.5 * (p + 1) + 0.25 * r + 2, 6) as u_x, round(-0.5 * r - 1, 6) as u_y from target"

# Tensors ------------------------------------------------------------------------------------------------------


def polar_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation in a product of a rotation and a stretch, by row."""
    a, s = F.col("embedding")[0].cast("double"), F.abs(F.col("embedding")[1].cast("double")) + 1.0
    c, d, zero, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    flat = tensors.polar_column([[c * s, -d * 2.0, zero], [d * s, c * 2.0, zero], [zero, zero, one]])
    return read(spark, sf_dir, "embeddings").select("vec_id", flat.alias("r")).select("vec_id", *[F.round(F.col("r")[k], 6).alias(f"r{k}") for k in (0, 1, 3, 4, 8)])


POLAR_SQL = """select vec_id, round(cos(embedding[1]::double), 6) as r0, round(-sin(embedding[1]::double), 6) as r1, round(sin(embedding[1]::double), 6) as r3,
  round(cos(embedding[1]::double), 6) as r4, 1.0::double as r8 from embeddings"""

_LPS = ReferenceFrame.declared("framegrid", "patient", patient_coordinate_system("LPS", "mm", axes=("l", "p", "s")))
_SRA = _LPS.with_coordinate_system(patient_coordinate_system("SRA", "mm", axes=("s2", "r2", "a2")))


def component_basis_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at samples of a line, declared, rewritten in another system, with one component picked."""
    t = AffineTransform.from_matrix(np.array([[1.0], [0], [0]]), source=ArrayCoordinates(("i",), ("1",), sample_offset=(0.5,)), target=_LPS, translation=[0, 0, 0])
    rows = read(spark, sf_dir, "embeddings").filter("vec_id < 64")
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    table = frame_table(rows.select(F.col("vec_id").alias("pos_i"), v.alias("v")), Grid(t, {"i": ("i", np.arange(64))}), values=("v",))
    changed = declare_components(table, "v", tensors.VECTOR).change_basis(_SRA)
    picked = changed.select_component(1, name="r")
    out = changed.framed.df.select("pos_i", *[F.round(F.col("v")[k], 6).alias(n) for k, n in enumerate(("s", "r", "a"))])
    return out.join(picked.df.select("pos_i", F.round("r", 6).alias("picked")), "pos_i")


BASIS_SQL = """select vec_id as pos_i, round(embedding[3]::double, 6) as s, round(-embedding[1]::double, 6) as r, round(-embedding[2]::double, 6) as a,
  round(-embedding[1]::double, 6) as picked from embeddings where vec_id < 64"""


def resample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on the price surface, interpolated and turned with the map between the frames."""
    moved = ReferenceFrame.declared("framegrid", "turned-plane", _SYSTEM)
    over = AffineTransform.from_matrix([[0, 2], [-1, 0]], source=moved, target=PLANE, translation=[0, 0])
    base = oblique_grid()
    target = Grid(compose(base.transform, over.inverse()), {"u": ("u", np.arange(40)), "v": ("v", np.arange(8))})
    values = surface(spark, sf_dir).select("pos_q", "pos_d", F.array(F.col("value"), F.col("value") * 3).alias("v"))
    out = resample_components(values, surface_grid(), target, column="v", size=2, kind=tensors.VECTOR, transform=over, fill_value=0.0)
    return out.select("pos_u", "pos_v", F.round(F.col("v")[0], 4).alias("x"), F.round(F.col("v")[1], 4).alias("y"))


VECTORS_SQL = f"""
with {SURFACE_SQL}, {_oblique_sql()},
placed as (select *, p >= -1e-9 and p <= 49 + 1e-9 and r >= -1e-9 and r <= 10 + 1e-9 as inside, least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from target),
w as (select *, floor(cp) as i, floor(cr) as j, cp - floor(cp) as fp, cr - floor(cr) as fr from placed),
v as (select pos_u, pos_v, case when inside then (1 - fp) * (1 - fr) * a.value + fp * (1 - fr) * coalesce(b.value, 0) + (1 - fp) * fr * coalesce(d.value, 0) + fp * fr * coalesce(e.value, 0) else 0 end as v
  from w left join cells a on a.pos_q = i and a.pos_d = j left join cells b on b.pos_q = i + 1 and b.pos_d = j
  left join cells d on d.pos_q = i and d.pos_d = j + 1 left join cells e on e.pos_q = i + 1 and e.pos_d = j + 1)
select pos_u, pos_v, round(-3 * v + 0.0, 4) as x, round(0.5 * v, 4) as y from v
"""


def pole_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East and north components across a pole: both are reversed on the opposite meridian."""
    values = _globe(spark, sf_dir).select("pos_lat", "pos_lon", F.array(F.col("value"), F.col("value") * 2).alias("v"))
    target, grid = _fine(np.array([-90.0, -88.0, -86.0, 84.0, 86.5, 89.0]), np.arange(72) * 5.0), lon_lat_grid()
    out = resample_components(values, grid, target, column="v", size=2, kind=tensors.VECTOR, basis=tensors.EastNorthUp(grid.frame))
    return out.select("pos_lat", "pos_lon", F.round(F.col("v")[0], 4).alias("east"), F.round(F.col("v")[1], 4).alias("north"))


POLE_VECTORS_SQL = f"""
with {_GLOBE_SQL},
lats as (select unnest([-90.0, -88.0, -86.0, 84.0, 86.5, 89.0]::double[]) as lat, unnest(range(6)) as pos_lat),
wide as (select j, i, value from globe union all select -1, (i + 18) % 36, -value from globe where j = 0 union all select 18, (i + 18) % 36, -value from globe where j = 17),
target as (select pos_lat, range as pos_lon, (lat + 85) / 10 as r, range * 0.5::double as p from lats cross join range(72)),
c as (select *, floor(r)::bigint as j, floor(p)::bigint as i, r - floor(r) as fr, p - floor(p) as fp from target),
v as (select pos_lat, pos_lon, (1 - fr) * (1 - fp) * g.value + (1 - fr) * fp * h.value + fr * (1 - fp) * k.value + fr * fp * l.value as v from c
join wide g on g.j = c.j and g.i = c.i join wide h on h.j = c.j and h.i = (c.i + 1) % 36
join wide k on k.j = c.j + 1 and k.i = c.i join wide l on l.j = c.j + 1 and l.i = (c.i + 1) % 36)
select pos_lat, pos_lon, round(v, 4) as east, round(2 * v, 4) as north from v
"""

# Framed tables ------------------------------------------------------------------------------------------------


def concat_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one grid stacked along a new dimension."""
    a = framed(spark, sf_dir)
    tagged = lambda name, f: FramedDF(a.df.withColumn("part", F.lit(name)).withColumn("value", F.col("value") * f), a.grid, ("part",))
    return _out(tagged("once", 1.0).concat([tagged("twice", 2.0)], "part").df, "pos_q", "pos_d", "q", "d", "part")


CONCAT_SQL = f"""with {SURFACE_SQL} select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, part, round(value * f, 4) as value
  from cells cross join (values ('once', 1.0::double), ('twice', 2.0::double)) t(part, f)"""


def merge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table with the values of two, on their common labels."""
    a = framed(spark, sf_dir)
    b = a.isel(q=slice(10, 40), d=slice(3, 9))
    other = FramedDF(b.df.withColumn("double_value", F.col("value") * 2).drop("value"), b.grid, (), ("double_value",))
    return _out(a.merge(other).df, "pos_q", "pos_d", "q", "d", values=("value", "double_value"))


MERGE_SQL = f"""with {SURFACE_SQL} select pos_q - 10 as pos_q, pos_d - 3 as pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(value, 4) as value, round(2 * value, 4) as double_value
  from cells where pos_q between 10 and 39 and pos_d between 3 and 8"""


def assign_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced at another table's labels."""
    a = framed(spark, sf_dir)
    return _out(a.assign_at(a.isel(q=slice(5, 20, 3), d=slice(2, 4)).map_values(lambda c: -c)).df, "pos_q", "pos_d")


ASSIGN_SQL = f"""with {SURFACE_SQL} select pos_q, pos_d, round(case when pos_q between 5 and 19 and (pos_q - 5) % 3 = 0 and pos_d in (2, 3) then -value else value end, 4) as value from cells"""


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the whole table's labels; those that the window lacks are missing."""
    a = framed(spark, sf_dir)
    return _out(a.isel(q=slice(0, 12), d=slice(0, 5)).reindex_like(a).df, "pos_q", "pos_d", "q", "d")


REINDEX_SQL = f"""with {SURFACE_SQL} select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(case when pos_q < 12 and pos_d < 5 then value else {FILL} end, 4) as value from cells"""


def ends_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, tail and thinning, one after the other."""
    return _out(framed(spark, sf_dir).head(q=40).tail(q=30).thin(q=7, d=2).df, "pos_q", "pos_d", "q", "d")


ENDS_SQL = f"""with {SURFACE_SQL} select (pos_q - 10) // 7 as pos_q, pos_d // 2 as pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(value, 4) as value from cells
  where pos_q between 10 and 39 and (pos_q - 10) % 7 = 0 and pos_d % 2 = 0"""


def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample nearest to a point of the frame."""
    return _out(framed(spark, sf_dir).nearest_to({"x": 17.4, "y": 3.6}).df, "q", "d")


NEAREST_POINT_SQL = f"with {SURFACE_SQL} select 17.0::double as q, 4.0::double as d, round(value, 4) as value from cells where pos_q = 16 and pos_d = 4"


def renamed_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framed(spark, sf_dir).rename(q="amount", value="price").transpose("d", "amount").isel(amount=slice(4, 9))
    return _out(out.frame_coordinates().df, "pos_d", "pos_amount", "amount", "x", "y", values=("price",))


RENAMED_SQL = f"""with {SURFACE_SQL} select pos_d, pos_q - 4 as pos_amount, (pos_q + 1)::double as amount, (pos_q + 1)::double as x, pos_d::double as y, round(value, 4) as price
  from cells where pos_q between 4 and 8"""


def quantile_of_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over return flags: the geometry stays."""
    return _out(_by_status(spark, sf_dir).quantile(0.5, "l_returnflag").df, "pos_q", "pos_d", "q", "d")


_STATUS_SQL = """by_flag as (select cast(l_quantity - 1 as bigint) as pos_q, cast(round(l_discount * 100) as bigint) as pos_d, l_returnflag, sum(l_extendedprice) as value
  from lineitem group by 1, 2, 3)"""
QUANTILE_SQL = f"""with {_STATUS_SQL} select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, round(quantile_cont(value, 0.5), 4) as value from by_flag group by 1, 2, 3, 4"""


def carried_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried labels picked by their rank, which only their number needs on the driver."""
    return _out(_by_status(spark, sf_dir).isel(l_returnflag=slice(1, 3)).df, "pos_q", "pos_d", "l_returnflag")


RANK_SQL = f"""with {_STATUS_SQL}, k as (select l_returnflag, row_number() over (order by l_returnflag) - 1 as rank from (select distinct l_returnflag from by_flag))
select pos_q, pos_d, l_returnflag, round(value, 4) as value from by_flag join k using (l_returnflag) where rank between 1 and 2"""


def coarsened_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a carried, whole-numbered dimension averaged: line numbers in pairs."""
    q, d = (F.col("l_quantity") - 1).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    rows = read(spark, sf_dir, "lineitem").groupBy(q.alias("pos_q"), d.alias("pos_d"), F.col("l_linenumber").cast("long").alias("line")).agg(F.avg(F.ln("l_extendedprice")).alias("value"))
    return _out(frame_table(rows, surface_grid(), carried=["line"]).coarsen(line=2).df, "pos_q", "pos_d", "q", "d", "line")


COARSE_SQL = """with c as (select cast(l_quantity - 1 as bigint) as pos_q, cast(round(l_discount * 100) as bigint) as pos_d, l_linenumber as line, avg(ln(l_extendedprice)) as value
  from lineitem group by 1, 2, 3)
select pos_q, pos_d, (pos_q + 1)::double as q, pos_d::double as d, (line // 2)::bigint as line, round(avg(value), 4) as value from c group by 1, 2, 3, 4, 5"""


def adopted_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without an identity adopts a frame and then combines with one of that frame."""
    a = framed(spark, sf_dir)
    grid = surface_grid()
    nameless = Grid.of(grid.transform.with_endpoints(target=ReferenceFrame.anonymous(_SYSTEM)), grid.axes, grid.dims)
    b = frame_table(surface(spark, sf_dir), nameless).assume_frame(PLANE)
    return _out((a * 3.0 - b).df, "pos_q", "pos_d")


ADOPTED_SQL = f"with {SURFACE_SQL} select pos_q, pos_d, round(2 * value, 4) as value from cells"


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values where a condition holds, a constant elsewhere, along added labels."""
    return _out(framed(spark, sf_dir).where(lambda c: c > 10.3, 0.0).expand_dims(run=[1, 2]).df, "pos_q", "pos_d", "run")


MASKED_SQL = f"with {SURFACE_SQL} select pos_q, pos_d, run, round(case when value > 10.3 then value else 0 end, 4) as value from cells cross join (values (1), (2)) r(run)"


def first_failing_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples lie over a bound, and the first of them in the order of the dimensions."""
    out = first_failure(surface(spark, sf_dir), F.col("value") > 10.5, ["q", "d"])
    return out.select("n", F.col("first.pos_q").alias("pos_q"), F.col("first.pos_d").alias("pos_d"))


FAILURE_SQL = f"""with {SURFACE_SQL}, f as (select pos_q, pos_d, row_number() over (order by pos_q, pos_d) as k from cells where value > 10.5)
select (select count(*) from f)::bigint as n, (select pos_q from f where k = 1) as pos_q, (select pos_d from f where k = 1) as pos_d"""


def coincidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the points of two samplings of one grid lie apart."""
    grid = oblique_grid()
    a = grid.to_df(spark, points=True)
    out = coincidence(a, a.withColumn("x", F.col("x") + F.col("pos_u") * 0.001), grid)
    return out.select("n", F.round("maximum", 6).alias("maximum"))


COINCIDENCE_SQL = "select 320::bigint as n, 0.039::double as maximum"

# Orientation ---------------------------------------------------------------------------------------------------


def _scan() -> Grid:
    """Axes that run back, down and left, the last a little oblique."""
    m = np.array([[0, 0, 2.0], [1.5, 0, 0.1], [0, -3.0, 0]])
    t = AffineTransform.from_matrix(m, source=ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3), target=_LPS, translation=[1, 2, 3])
    return Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (3, 4, 5), strict=True)})


def reoriented_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples numbered along left, front and up: permuted and reversed, not moved."""
    grid = reoriented(_scan(), "LAS")
    out = grid.to_df(spark, points=True).select(*[F.col(f"pos_{d}").alias(f"pos_{n}") for n, d in enumerate(grid.dims)], "l", "p", "s")
    return out.select("pos_0", "pos_1", "pos_2", *[F.round(c, 6).alias(c) for c in "lps"], F.lit(orientation_codes(grid)).alias("codes"))


REORIENTED_SQL = """with s as (select i.range as i, j.range as j, k.range as k from range(3) i, range(4) j, range(5) k)
select k as pos_0, 2 - i as pos_1, 3 - j as pos_2, round(2.0::double * k + 1, 6) as l, round(1.5::double * i + 0.1::double * k + 2, 6) as p, round(-3.0::double * j + 3, 6) as s,
  'LAS' as codes from s"""


def scalar_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target without dimensions is one row."""
    source = ArrayCoordinates(("u", "v"), ("1", "1"))
    t = AffineTransform.from_matrix(np.eye(2), source=source, target=PLANE, translation=[0, 0])
    return _out(resample(surface(spark, sf_dir), surface_grid(), Grid(t, {"u": ("u", np.array([12.25, 13])), "v": ("v", np.array([4.5, 5]))}).isel(u=0, v=0), fill_value=FILL))


SCALAR_SQL = f"""with {SURFACE_SQL} select round(sum(value * case pos_q when 11 then 0.75 else 0.25 end * 0.5), 4) as value from cells where pos_q in (11, 12) and pos_d in (4, 5)
"""

ALL = [
    (user_map, USER_SQL), (composite_chart_map, COMPOSITE_SQL), (spherical_round_trip, SPHERICAL_SQL), (affine_inverse, INVERSE_SQL),
    (field_jacobian, FIELD_JACOBIAN_SQL), (position_field_map, POSITION_SQL), (field_map_by_join, FIELD_SQL), (sampled_displacements, SAMPLED_SQL),
    (polar_rotation, POLAR_SQL), (component_basis_change, BASIS_SQL), (resample_vectors, VECTORS_SQL), (pole_vectors, POLE_VECTORS_SQL),
    (concat_carried, CONCAT_SQL), (merge_values, MERGE_SQL), (assign_window, ASSIGN_SQL), (reindexed, REINDEX_SQL), (ends_and_steps, ENDS_SQL),
    (nearest_sample, NEAREST_POINT_SQL), (renamed_transposed, RENAMED_SQL), (quantile_of_carried, QUANTILE_SQL), (carried_by_rank, RANK_SQL),
    (coarsened_lines, COARSE_SQL), (adopted_frame, ADOPTED_SQL), (masked_values, MASKED_SQL), (first_failing_sample, FAILURE_SQL),
    (coincidence_report, COINCIDENCE_SQL), (reoriented_points, REORIENTED_SQL), (scalar_target, SCALAR_SQL),
]

__all__ = ["ALL"]
