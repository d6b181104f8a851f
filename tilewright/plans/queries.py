"""The registered queries over the test tables, each beside the SQL that DuckDB answers it with."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import EdgeConfig
from ..functions import arrays
from ..operators import backends, canny, circuit, metrics, post, resample, stencils, strips, tiling
from ..sources import images, jpeg, png, rasters, results, synthetic
from . import detection

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, alias: str, digits: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), digits).alias(alias)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", arrays.doubles(F.col("embedding")).alias("c"))


_P = """p as (select vec_id, (k // 8)::int as y, (k % 8)::int as x, k::int as k, embedding[k + 1]::double as v from embeddings, range(64) t(k))"""
_G = _P + """, g as (select vec_id, k, y, x, v, v - lead(v) over (partition by vec_id, y order by x) as h, v - lead(v) over (partition by vec_id, x order by y) as g from p)"""
_EV = "with " + rasters.EVENTS_SQL
_LI = "with " + rasters.LINEITEM_SQL
_N = """n as (select image_id, h, w, y, x, v, coalesce(lead(v) over r, v) as vr, coalesce(lag(v) over r, v) as vl,
    coalesce(lead(v) over c, v) as vd, coalesce(lag(v) over c, v) as vu from px
    window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y))"""
_Q = _N + ", q as (select image_id, h, w, y, x, sqrt((v - vr) * (v - vr) + (v - vd) * (v - vd)) as m from n)"
_QN = _Q + ", qn as (select image_id, h, w, y, x, case when max(m) over (partition by image_id) > 1e-9 then m / max(m) over (partition by image_id) else 0.0 end as m from q)"


def _normal(of: str) -> str:
    return f"select image_id, h, w, y, x, case when max(m) over (partition by image_id) > 1e-9 then m / max(m) over (partition by image_id) else 0.0 end as m from {of}"


def _two_pass(smooth: float, p: str = "s") -> str:
    """CTEs {p}m (magnitudes) and {p}n (normalised)."""
    return (
        f"{p}r as (select image_id, h, w, y, x, vl + {smooth} * v + vr as s, vr - vl as d from n), "
        f"{p}g as (select image_id, h, w, y, x, coalesce(lag(d) over c, d) + {smooth} * d + coalesce(lead(d) over c, d) as gx, "
        f"coalesce(lead(s) over c, s) - coalesce(lag(s) over c, s) as gy from {p}r window c as (partition by image_id, x order by y)), "
        f"{p}m as (select image_id, h, w, y, x, sqrt(gx * gx + gy * gy) as m from {p}g), {p}n as ({_normal(p + 'm')})"
    )


_LAPLACIAN = (
    "lr as (select image_id, h, w, y, x, v, vl + vr as e from n), lm as (select image_id, h, w, y, x, abs(2.0 * (coalesce(lag(e) over c, e) + coalesce(lead(e) over c, e)) - 8.0 * v) as m from lr window c as (partition by image_id, x order by y)), "
    f"ln as ({_normal('lm')})"
)
#: Blurred byte levels and the thresholds of their medians.
_LEVELS = """b0 as (select image_id, h, w, y, x, floor(least(greatest(v * 255, 0), 255))::int as v from px),
b1 as (select image_id, h, w, y, x, coalesce(lag(v) over r, lead(v) over r, v) + 2 * v + coalesce(lead(v) over r, lag(v) over r, v) as v from b0 window r as (partition by image_id, y order by x)),
bl as (select image_id, h, w, y, x, (coalesce(lag(v) over c, lead(v) over c, v) + 2 * v + coalesce(lead(v) over c, lag(v) over c, v) + 8) // 16 as v from b1 window c as (partition by image_id, x order by y)),
cuts as (select image_id, greatest(10, 0.67 * median(v)) as low, least(255, greatest(2 * greatest(10, 0.67 * median(v)), 1.33 * median(v))) as high from bl group by image_id)"""
#: Canny: integer gradients, thinning along one of four directions, and a recursion from strong to weak neighbours. Ends in ``cm`` (all pixels, m 0 or 1).
_CANNY = _LEVELS + """,
c0 as (select image_id, h, w, y, x, v, coalesce(lead(v) over r, v) as r1, coalesce(lag(v) over r, v) as l1 from bl window r as (partition by image_id, y order by x)),
c1 as (select image_id, h, w, y, x, r1 - l1 as d, l1 + 2 * v + r1 as s from c0),
c2 as (select image_id, h, w, y, x, coalesce(lag(d) over c, d) + 2 * d + coalesce(lead(d) over c, d) as gx, coalesce(lead(s) over c, s) - coalesce(lag(s) over c, s) as gy from c1 window c as (partition by image_id, x order by y)),
c3 as (select image_id, h, w, y, x, gx, gy, abs(gx) + abs(gy) as m from c2),
c4 as (select *, coalesce(lag(m) over r, 0) as ml, coalesce(lead(m) over r, 0) as mr, coalesce(lag(m) over c, 0) as mu, coalesce(lead(m) over c, 0) as md from c3 window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)),
c5 as (select *, coalesce(lag(ml) over c, 0) as mul, coalesce(lag(mr) over c, 0) as mur, coalesce(lead(ml) over c, 0) as mdl, coalesce(lead(mr) over c, 0) as mdr from c4 window c as (partition by image_id, x order by y)),
thin as materialized (select image_id, y, x, m > high as strong from c5 join cuts using (image_id) where m > low and case
    when abs(gy) * 32768 < abs(gx) * 13573 then m > ml and m >= mr
    when abs(gy) * 32768 > abs(gx) * (13573 + 65536) then m > mu and m >= md
    when (gx < 0) = (gy < 0) then m > mul and m > mdr else m > mur and m > mdl end),
found as (select image_id, y, x from thin where strong union
    select t.image_id, t.y, t.x from found f join thin t on t.image_id = f.image_id and t.y between f.y - 1 and f.y + 1 and t.x between f.x - 1 and f.x + 1),
cm as (select px.image_id, px.h, px.w, px.y, px.x, (found.y is not null)::int::double as m from px left join found using (image_id, y, x))"""


# ------------------------------------------------------------- tiles of embeddings

@query(f"with {_G} select vec_id, y, x, round(sqrt(h * h + g * g), 6) as mag from g where h is not null and g is not null")
def qhed_tile_magnitude(spark, sf):
    core = _embeddings(spark, sf).select("vec_id", F.posexplode(arrays.magnitude(F.col("c"), 8)).alias("k", "m"))
    return core.select("vec_id", F.floor(F.col("k") / 7).cast("int").alias("y"), (F.col("k") % 7).alias("x"), _r("m", "mag"))


@query(f"with {_G} select vec_id, y, x, round(h, 6) as h, round(g, 6) as v from g where h is not null and g is not null")
def qhed_responses(spark, sf):
    both = arrays.core(F.col("c"), 8, lambda p, r, d: F.struct((p - r).alias("h"), (p - d).alias("v")))
    core = _embeddings(spark, sf).select("vec_id", F.posexplode(both).alias("k", "z"))
    return core.select("vec_id", F.floor(F.col("k") / 7).cast("int").alias("y"), (F.col("k") % 7).alias("x"), _r(F.col("z.h"), "h"), _r(F.col("z.v"), "v"))


@query(f"with {_P} select vec_id, k as i, round(v - coalesce(lead(v) over (partition by vec_id order by k), first_value(v) over (partition by vec_id order by k)), 6) as d from p")
def qhed_cyclic_differences(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.posexplode(arrays.cyclic_differences(F.col("c"))).alias("i", "d")).select("vec_id", "i", _r("d", "d"))


@query(f"with {_P}, n as (select vec_id, sqrt(sum(v * v)) as n from p group by vec_id) select vec_id, k as i, round(v / n, 6) as amp, round(n, 6) as norm from p join n using (vec_id)")
def amplitude_encode(spark, sf):
    enc = _embeddings(spark, sf).select("vec_id", arrays.amplitudes(F.col("c")).alias("z"))
    return enc.select("vec_id", "z.norm", F.posexplode("z.amps").alias("i", "a")).select("vec_id", "i", _r("a", "amp"), _r("norm", "norm"))


@query(
    f"with {_P}, n as (select vec_id, k, v / sqrt(sum(v * v) over (partition by vec_id)) as a from p), s as (select vec_id, k, a, coalesce(lead(a) over (partition by vec_id order by k), first_value(a) over (partition by vec_id order by k)) as b from n) "
    "select vec_id, 2 * k as k, round((a + b) / 2, 6) as s from s union all select vec_id, 2 * k + 1, round((a - b) / 2, 6) from s"
)
def qhed_statevector(spark, sf):
    enc = _embeddings(spark, sf).select("vec_id", arrays.statevector(arrays.amplitudes(F.col("c"))["amps"]).alias("s"))
    return enc.select("vec_id", F.posexplode("s").alias("k", "s")).select("vec_id", "k", _r("s", "s"))


@query(f"with {_P} select vec_id, (x * 8 + y)::int as k, round(v, 6) as v from p")
def tile_transpose(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.posexplode(arrays.transposed(F.col("c"), 8)).alias("k", "v")).select("vec_id", "k", _r("v", "v"))


_POWER = "(1 << ceil(log2({0}))::int)::int"


@query(
    f"with {_P}, s as (select vec_id, count(*) as n, sqrt(sum(v * v)) as norm, sum(v) as total from p group by vec_id) select vec_id, {_POWER.format('n')} as padded, {_POWER.format('(n + 1)')} as padded_more, round(total, 6) as total, "
    "log2(n)::int as qubits, abs(norm - 1) <= 1e-5 as unit, abs(norm - 1) <= 1e-9 as unit_9, abs(norm - 1) <= 1e-7 as unit_7 from s"
)
def encoding_checks(spark, sf):
    c = F.col("c")
    more = arrays.padded_to_power_of_two(F.concat(c, F.array(F.lit(0.0))))
    return _embeddings(spark, sf).select(
        "vec_id", F.size(arrays.padded_to_power_of_two(c)).alias("padded"), F.size(more).alias("padded_more"), _r(F.aggregate(more, F.lit(0.0), lambda a, e: a + e), "total"),
        arrays.data_qubits(F.size("c")).alias("qubits"), arrays.has_unit_norm(c, 1e-5).alias("unit"), arrays.has_unit_norm(c, 1e-9).alias("unit_9"), arrays.has_unit_norm(c).alias("unit_7"),
    )


_STATE = f"{_P}, a as (select vec_id, k, v / sqrt(sum(v * v) over (partition by vec_id)) as a from p), b as (select vec_id, k, a, coalesce(lead(a) over (partition by vec_id order by k), first_value(a) over (partition by vec_id order by k)) as b from a), s as (select vec_id, 2 * k as k, (a + b) / 2 as s from b union all select vec_id, 2 * k + 1, (a - b) / 2 from b)"


@query(
    f"with {_STATE}, d as (select vec_id, max(round(s * s, 12)) as top, sum(s) filter (where k % 2 = 0) as even from s group by vec_id), f as (select vec_id, min(k) as dominant from s join d using (vec_id) where round(s * s, 12) = top group by vec_id) "
    "select vec_id, k, round(case when even < 0 then -s else s end, 6) as s, dominant::int as dominant from s join d using (vec_id) join f using (vec_id)"
)
def global_phase(spark, sf):
    """States turned by a phase of their own, and back."""
    theta = 0.7 + F.col("vec_id") % 5
    enc = _embeddings(spark, sf).select("vec_id", theta.alias("t"), arrays.statevector(arrays.amplitudes(F.col("c"))["amps"]).alias("s"))
    turned = enc.select("vec_id", F.transform("s", lambda v: v * F.cos(F.col("t"))).alias("re"), F.transform("s", lambda v: v * F.sin(F.col("t"))).alias("im"))
    real = turned.select("vec_id", arrays.dominant(F.col("re"), F.col("im")).alias("dominant"), F.posexplode(arrays.real_state(F.col("re"), F.col("im"))).alias("k", "s"))
    return real.select("vec_id", "k", _r("s", "s"), "dominant")


# ------------------------------------------------------------- scene and rasters

_SCENE = f"with s as (select (k // 128)::int as y, (k % 128)::int as x from range(96 * 128) t(k)), l as (select y, x, {synthetic.label_sql(96, 128)} as label from s)"
_LEVEL = "case label " + " ".join(f"when {k} then {v}::double" for k, v in enumerate(synthetic.INTENSITIES)) + " end"


@query(f"{_SCENE} select y, x, label, {_LEVEL} as v from l")
def synthetic_scene(spark, sf):
    return synthetic.scene(spark, 96, 128).select("y", "x", "label", "v")


@query(f"{_SCENE} select y, x, label, coalesce(label <> lead(label) over (partition by y order by x), false) or coalesce(label <> lead(label) over (partition by x order by y), false) as e from l")
def label_edges(spark, sf):
    return stencils.label_edges(synthetic.scene(spark, 96, 128)).select("y", "x", "label", "e")


@query(f"{_EV} select image_id, y, x, round(v, 6) as v from px")
def raster_events(spark, sf):
    return rasters.events(spark, sf).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_LI} select image_id, y, x, round(v, 6) as v from px")
def raster_lineitem(spark, sf):
    return rasters.lineitem(spark, sf).select("image_id", "y", "x", _r("v", "v"))


@query("select l_linenumber as r, l_returnflag as id, l_orderkey as k, round(least(greatest((0.299::double * (l_quantity::int) + 0.587::double * (l_linenumber * 30) + 0.114::double * (l_suppkey % 256)) / 255, 0), 1), 6) as v from lineitem")
def rgb_to_gray(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = images.grey_of(F.col("l_quantity").cast("int"), F.col("l_linenumber") * 30, F.col("l_suppkey") % 256, 255)
    return x.select(F.col("l_linenumber").alias("r"), F.col("l_returnflag").alias("id"), F.col("l_orderkey").alias("k"), _r(v, "v"))


# ------------------------------------------------------------- tiling

_SPLIT = """t as (select image_id, h, w, (r * ceil(w / 7.0) + c)::int as tile_id, k::int as k, least(r * 7 + k // 8, h - 1)::int as y, least(c * 7 + k % 8, w - 1)::int as x
    from (select distinct image_id, h, w from px), range(5) a(r), range(4) b(c), range(64) z(k))"""


@query(f"{_EV}, {_SPLIT} select t.image_id, t.tile_id, t.k, round(px.v, 6) as v from t join px using (image_id, y, x)")
def tile_split(spark, sf):
    return tiling.split(rasters.events(spark, sf), 8).select("image_id", "tile_id", F.posexplode("px").alias("k", "v")).select("image_id", "tile_id", "k", _r("v", "v"))


@query(f"{_EV}, {_SPLIT} select t.image_id, t.tile_id, t.k, round(px.v, 6) as v from t join px using (image_id, y, x) where t.tile_id >= 5 and t.tile_id < 12")
def tile_batch(spark, sf):
    return tiling.batch(tiling.split(rasters.events(spark, sf), 8), 5, 12).select("image_id", "tile_id", F.posexplode("px").alias("k", "v")).select("image_id", "tile_id", "k", _r("v", "v"))


@query(f"{_EV} select image_id, y, x, (y * 24 + x)::int as k from px")
def pixel_index(spark, sf):
    k = rasters.events(spark, sf).select("image_id", arrays.index_of(F.col("y"), F.col("x"), 30, 24).alias("k"))
    return k.select("image_id", "k", arrays.coordinates_of(F.col("k"), 30, 24).alias("at")).select("image_id", "at.y", "at.x", "k")


@query(f"{_EV}, {_SPLIT}, v as (select t.image_id, t.tile_id, t.k, px.v from t join px using (image_id, y, x)) select image_id, tile_id, k, round(v / coalesce(nullif(max(v) over (partition by image_id, tile_id), 0), 1), 6) as v from v")
def tile_normalised(spark, sf):
    tiles = tiling.split(rasters.events(spark, sf), 8).select("image_id", "tile_id", F.posexplode(post.tile_normalised(F.col("px"))).alias("k", "v"))
    return tiles.select("image_id", "tile_id", "k", _r("v", "v"))


@query(f"{_EV} select image_id, y, x, round(v, 6) as v from px")
def tile_stitch_roundtrip(spark, sf):
    tiles = tiling.split(rasters.events(spark, sf), 8).withColumn("core", tiling.core_of(F.col("px"), 8))
    return tiling.stitch(tiles, 8).select("image_id", "y", "x", _r("m", "v"))


_GRIDS = [(h, w, t) for h, w in ((64, 64), (37, 53), (1, 1), (2, 9), (15, 16), (100, 7), (2160, 3840)) for t in (4, 8, 16)]


@query(
    "with g(h, w, t) as (values " + ", ".join(map(str, _GRIDS)) + ") select h, w, t, ceil(h / (t - 1.0))::int as rows, ceil(w / (t - 1.0))::int as cols, (ceil(h / (t - 1.0)) * ceil(w / (t - 1.0)))::int as num_tiles, "
    "t - 1 as core_size, 1 as halo_size, t * t as padded_vector_length, (log2(t * t) + 1)::int as num_qubits from g"
)
def tile_grid_meta(spark, sf):
    out = None
    g = spark.createDataFrame(_GRIDS, "h int, w int, t int")
    for t in (4, 8, 16):
        part = g.where(F.col("t") == t)
        part = part.select("h", "w", "t", *[c.alias(n) for n, c in tiling.grid_columns(F.col("h"), F.col("w"), t).items()])
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_EV}, {_Q} select image_id, y, x, round(m, 6) as m from q")
def qhed_tiled_raster(spark, sf):
    cores = backends.run_tiles(tiling.split(rasters.events(spark, sf), 8), 8, backends.get("exact"))
    return tiling.stitch(cores, 8).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_LI}, {_Q} select image_id, y, x, round(m, 6) as m from q")
def qhed_pixels(spark, sf):
    return stencils.qhed(rasters.lineitem(spark, sf)).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_LI}, {_Q} select image_id, y, x, round(m, 6) as m from q")
def qhed_strips(spark, sf):
    return strips.to_pixels(strips.qhed(strips.from_lines(rasters.lineitem(spark, sf), 16))).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_EV}, {_Q} select image_id, y, x, round(m, 6) as m from q")
def qhed_circuit(spark, sf):
    cores = backends.run_tiles(tiling.split(rasters.events(spark, sf), 4), 4, backends.get("circuit"))
    return tiling.stitch(cores, 4).select("image_id", "y", "x", _r("m", "m"))


# ------------------------------------------------------------- after the detector

@query(f"{_EV}, {_QN} select image_id, y, x, round(m, 6) as m from qn")
def normalise(spark, sf):
    return post.normalise(stencils.qhed(rasters.events(spark, sf))).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_EV}, {_QN} select image_id, y, x, round(m, 6) >= 0.2 as pipeline_02, m > 0 as pipeline_0, round(m, 6) >= 0.2 as classical_02, m >= 1e-12 as classical_0, m >= 1e-9 as fixed_0 from qn")
def thresholds(spark, sf):
    n, m = post.normalise(stencils.qhed(rasters.events(spark, sf))), F.col("m")
    r = F.round(m, 6)
    return n.select("image_id", "y", "x", post.over_pipeline(r, 0.2).alias("pipeline_02"), post.over_pipeline(m, 0).alias("pipeline_0"), post.over_classical(r, 0.2).alias("classical_02"), post.over_classical(m, 0).alias("classical_0"), post.over_fixed(m, 0).alias("fixed_0"))


@query(f"{_EV}, {_QN}, c as (select image_id, quantile_cont(round(m, 6), 0.85) as cut from qn where m > 1e-9 group by image_id) select image_id, y, x, coalesce(round(m, 6) >= greatest(cut, 1e-9), false) as e from qn left join c using (image_id)")
def threshold_adaptive(spark, sf):
    n = post.normalise(stencils.qhed(rasters.events(spark, sf))).withColumn("m", F.round("m", 6))
    return post.adaptive(n).select("image_id", "y", "x", "e")


_RESIZED = (
    "wy as (select y, oy, (least((oy + 1) * 2.5::double, y + 1) - greatest(oy * 2.5::double, y)) / 2.5::double as wy from range(30) a(y), range(12) b(oy) where least((oy + 1) * 2.5::double, y + 1) > greatest(oy * 2.5::double, y)), "
    "wx as (select x, ox, (least((ox + 1) * 2.4::double, x + 1) - greatest(ox * 2.4::double, x)) / 2.4::double as wx from range(24) a(x), range(10) b(ox) where least((ox + 1) * 2.4::double, x + 1) - greatest(ox * 2.4::double, x) > 1e-9)"
)


@query(f"{_EV}, {_RESIZED} select image_id, oy::int as y, ox::int as x, round(sum(v * wy * wx), 6) as v from px join wy using (y) join wx using (x) group by all")
def area_resize(spark, sf):
    return resample.resize(rasters.events(spark, sf), 30, 24, 12).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_EV}, {_N}, {_two_pass(2.0)}, d as (select qx.image_id, qx.y, qx.x, sqrt((v - vr) * (v - vr) + (v - vd) * (v - vd)) - sm.m as v from n qx join sm using (image_id, y, x)), {_RESIZED} select image_id, oy::int as y, ox::int as x, round(sum(v * wy * wx), 6) as v from d join wy using (y) join wx using (x) group by all")
def signed_downscale(spark, sf):
    px = rasters.events(spark, sf)
    diff = post.signed_difference(stencils.qhed(px), stencils.sobel(px)).withColumnRenamed("diff", "v")
    return resample.resize(diff, 30, 24, 12, clip=False).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_EV}, {_RESIZED}, z as (select image_id, oy::int as y, ox::int as x, sum(v * wy * wx) as v from px join wy using (y) join wx using (x) group by all) select image_id, y, x, floor(least(greatest(v, 0), 1) * 255 + 0.5)::int as level from z")
def preview(spark, sf):
    return images.preview(rasters.events(spark, sf), 30, 24, "v", 12).select("image_id", "y", "x", "level")


@query(f"{_EV} select image_id, y::int as y, x::int as x, round(v, 6) as v from px where y < 8 and x < 8")
def crop(spark, sf):
    return post.crop(rasters.events(spark, sf)).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_EV}, e as (select (k // 40)::int as y, (k % 40)::int as x from range(1600) t(k)) select image_id, e.y, e.x, round(v, 6) as v from e join px on px.y = least(e.y, 23) and px.x = least(e.x, 23)")
def crop_padded(spark, sf):
    return post.crop(rasters.events(spark, sf), 40).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_EV} select image_id, y, x, floor(least(greatest(v, 0), 1) * 255 + 0.5)::int as level from px")
def byte_levels(spark, sf):
    return rasters.events(spark, sf).select("image_id", "y", "x", post.byte_level(F.col("v")).alias("level"))


@query(f"{_EV}, {_QN}, {_two_pass(2.0)} select qn.image_id, qn.y, qn.x, round(qn.m - sn.m, 6) as diff from qn join sn using (image_id, y, x)")
def signed_difference(spark, sf):
    px = rasters.events(spark, sf)
    return post.signed_difference(post.normalise(stencils.qhed(px)), post.normalise(stencils.sobel(px))).select("image_id", "y", "x", _r("diff", "diff"))


# ------------------------------------------------------------- classical detectors

@query(f"{_LI}, {_N}, {_two_pass(2.0)} select image_id, y, x, round(m, 6) as m from sn")
def sobel(spark, sf):
    return post.normalise(stencils.sobel(rasters.lineitem(spark, sf))).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_LI}, {_N}, {_two_pass(1.0)} select image_id, y, x, round(m, 6) as m from sn")
def prewitt(spark, sf):
    return post.normalise(stencils.prewitt(rasters.lineitem(spark, sf))).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_LI}, {_N}, {_LAPLACIAN} select image_id, y, x, round(m, 6) as m from ln")
def laplacian(spark, sf):
    return post.normalise(stencils.laplacian(rasters.lineitem(spark, sf))).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_EV}, {_LEVELS} select image_id, round(low, 6) as low, round(high, 6) as high from cuts")
def canny_thresholds(spark, sf):
    return canny.threshold_table(rasters.events(spark, sf)).select("image_id", _r("low", "low"), _r("high", "high"))


_CANNY_LI = f"{_LI}, {_CANNY} select image_id, y, x, m from cm".replace("with ", "with recursive ", 1)


@query(_CANNY_LI)
def canny_edges(spark, sf):
    return canny.detect(rasters.lineitem(spark, sf)).select("image_id", "y", "x", "m")


@query(_CANNY_LI)
def canny_strips(spark, sf):
    return strips.canny_pixels(strips.canny_masks(strips.from_lines(rasters.lineitem(spark, sf), 16, strips.HALO))).select("image_id", "y", "x", "m")


def _in_strips(method: str):
    def run(spark, sf):
        return strips.to_pixels(strips.magnitudes(strips.from_lines(rasters.lineitem(spark, sf), 16), method)).select("image_id", "y", "x", _r("m", "m"))

    run.__name__ = f"{method}_strips"
    return run


for _m, _sql in (("sobel", f"{_two_pass(2.0)} select image_id, y, x, round(m, 6) as m from sm"), ("prewitt", f"{_two_pass(1.0)} select image_id, y, x, round(m, 6) as m from sm"), ("laplacian", f"{_LAPLACIAN} select image_id, y, x, round(m, 6) as m from lm")):
    query(f"{_LI}, {_N}, {_sql}")(_in_strips(_m))


_INSIDE = "case when y > 0 and y < h - 1 and x > 0 and x < w - 1 then m / 4 else 0.0 end"


@query(f"{_LI}, {_N}, {_two_pass(2.0)}, i as (select image_id, y, x, round({_INSIDE}, 6) as m from sm) select image_id, y, x, m, case when m > 0.15 then 1.0 when m > 0.05 then 0.5 else 0.0 end::double as level from i")
def interior_sobel(spark, sf):
    m = post.interior_sobel(rasters.lineitem(spark, sf)).withColumn("m", F.round("m", 6))
    return m.select("image_id", "y", "x", "m", post.two_levels(F.col("m")).alias("level"))


# ------------------------------------------------------------- quality

_MASKS = f"{_EV}, {_QN}, {_two_pass(2.0)}, a as (select image_id, h, w, y, x, round(m, 6) as m, round(m, 6) >= 0.2 as e from qn), b as (select image_id, h, w, y, x, round(m, 6) as m, round(m, 6) >= 0.2 as e from sn)"


def _masks(spark, sf):
    px = rasters.events(spark, sf)
    of = lambda f: post.normalise(f(px)).withColumn("m", F.round("m", 6)).withColumn("e", F.col("m") >= 0.2)
    return of(stencils.qhed), of(stencils.sobel)


@query(f"{_MASKS} select image_id, round(case when avg((a.m - b.m) * (a.m - b.m)) = 0 then 'infinity'::double else 10 * log10(1 / avg((a.m - b.m) * (a.m - b.m))) end, 6) as psnr from a join b using (image_id, y, x) group by image_id")
def psnr(spark, sf):
    return metrics.psnr(metrics.aligned(*_masks(spark, sf), "m")).select("image_id", _r("psnr", "psnr"))


@query(
    f"{_MASKS}, p as (select image_id, a.h, a.w, y, x, a.m as a, b.m as b from a join b using (image_id, y, x)), "
    "r as (select image_id, h, w, y, x, sum(a) over f as sa, sum(b) over f as sb, sum(a * a) over f as saa, sum(b * b) over f as sbb, sum(a * b) over f as sab from p window f as (partition by image_id, y order by x rows between 3 preceding and 3 following)), "
    "c as (select image_id, h, w, y, x, sum(sa) over f / 49 as ux, sum(sb) over f / 49 as uy, sum(saa) over f / 49 as uxx, sum(sbb) over f / 49 as uyy, sum(sab) over f / 49 as uxy from r window f as (partition by image_id, x order by y rows between 3 preceding and 3 following)) "
    "select image_id, round(avg(((2 * ux * uy + 0.0001::double) * (2 * 49.0::double / 48 * (uxy - ux * uy) + 0.0009::double)) / ((ux * ux + uy * uy + 0.0001::double) * (49.0::double / 48 * (uxx - ux * ux) + 49.0::double / 48 * (uyy - uy * uy) + 0.0009::double))), 5) as ssim "
    "from c where y >= 3 and y < h - 3 and x >= 3 and x < w - 3 group by image_id"
)
def ssim(spark, sf):
    return metrics.ssim(metrics.aligned(*_masks(spark, sf), "m")).select("image_id", _r("ssim", "ssim", 5))


@query(f"{_MASKS} select image_id, round(avg(e::int), 6) as edge_density from a group by image_id")
def edge_density(spark, sf):
    return metrics.edge_density(_masks(spark, sf)[0]).select("image_id", _r("edge_density", "edge_density"))


def _scores_sql(tolerance: int) -> str:
    near = f"(p.y - r.y) * (p.y - r.y) + (p.x - r.x) * (p.x - r.x) <= {tolerance * tolerance}"
    return (
        f"{_MASKS}, s as (select image_id, count(*) filter (where e) as np from a group by image_id), t as (select image_id, count(*) filter (where e) as nr from b group by image_id), "
        f"hp as (select image_id, count(*) as hp from a p where e and exists (select 1 from b r where r.e and r.image_id = p.image_id and {near}) group by image_id), "
        f"hr as (select image_id, count(*) as hr from b r where e and exists (select 1 from a p where p.e and r.image_id = p.image_id and {near}) group by image_id), "
        "z as (select image_id, case when np = 0 and nr = 0 then 1.0 when np = 0 or nr = 0 then 0.0 else coalesce(hp, 0)::double / np end::double as p, case when np = 0 and nr = 0 then 1.0 when np = 0 or nr = 0 then 0.0 else coalesce(hr, 0)::double / nr end::double as r from s join t using (image_id) left join hp using (image_id) left join hr using (image_id)) "
        'select image_id, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from z'
    )


def _scores(tolerance: int):
    def run(spark, sf):
        return metrics.edge_scores(*_masks(spark, sf), tolerance).select("image_id", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))

    run.__name__ = f"edge_scores_tol{tolerance}"
    return run


for _t in (0, 1, 2):
    query(_scores_sql(_t))(_scores(_t))


@query(f"{_MASKS} select image_id, round(case when count(*) filter (where a.e or b.e) = 0 then 1.0 else count(*) filter (where a.e and b.e) / count(*) filter (where a.e or b.e) end, 6) as iou from a join b using (image_id, y, x) group by image_id")
def iou(spark, sf):
    return metrics.iou(*_masks(spark, sf)).select("image_id", _r("iou", "iou"))


@query(f"{_MASKS} select image_id, round(max(abs(a.m - b.m)), 6) as max_abs, round(avg(abs(a.m - b.m)), 6) as mean_abs from a join b using (image_id, y, x) group by image_id")
def absolute_error(spark, sf):
    return metrics.absolute_error(metrics.aligned(*_masks(spark, sf), "m")).select("image_id", _r("max_abs", "max_abs"), _r("mean_abs", "mean_abs"))


@query(f"{_MASKS} select image_id, bool_or(e) as any_edge, bool_and(e) as all_edges, bool_and(e or m < 0.2) as consistent from a group by image_id")
def any_all(spark, sf):
    a = _masks(spark, sf)[0]
    return a.groupBy("image_id").agg(F.bool_or("e").alias("any_edge"), F.bool_and("e").alias("all_edges"), F.bool_and(F.col("e") | (F.col("m") < 0.2)).alias("consistent"))


@query(f"{_MASKS} select image_id, y, x, round(m, 6) as m, e from a")
def pipeline_run(spark, sf):
    out = detection.run(rasters.events(spark, sf), 30, 24, EdgeConfig(threshold=0.2))
    return out.select("image_id", "y", "x", _r("m", "m"), (F.round("m", 6) >= 0.2).alias("e"))


# ------------------------------------------------------------- tables of results

def _values(rows, names: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return f"t({names}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_HD = "with " + _values([(k, *r) for k, r in enumerate(results.FULL_HD)], 'place, method, runtime_s, megapixels_per_s, ssim, psnr, "precision", recall, f1, iou')
_SW = "with " + _values(results.SWEEP, "width, height, method, runtime_s")


@query(_HD + ' select method, runtime_s, megapixels_per_s, ssim, psnr, "precision", recall, f1, iou from t')
def stored_results(spark, sf):
    return results.full_hd(spark)


_NAMES_SQL = "l as (select * from (values " + ", ".join(f"('{m}', '{a}', '{b}')" for m, (a, b) in results.LABELS.items()) + ") x(method, label, kind))"


@query(
    _HD + f", {_NAMES_SQL}, r as (select method, runtime_s from t union all values ('roberts', 0.5::double)) select method, coalesce(label, upper(method[1]) || lower(method[2:])) as label, coalesce(kind, 'Classical') as kind, "
    "round(runtime_s * 1000, 2) as runtime_ms, case when method = 'qhed' then 7 end as qubits from r left join l using (method)"
)
def labelled_results(spark, sf):
    """Labels by a join; a method that has none gets its name as a title."""
    names = spark.createDataFrame([(m, *x) for m, x in results.LABELS.items()], "method string, label string, kind string")
    rows = results.full_hd(spark).select("method", "runtime_s").unionByName(spark.createDataFrame([("roberts", 0.5)], "method string, runtime_s double"))
    joined = rows.join(F.broadcast(names), "method", "left")
    qubits = F.when(F.col("method") == "qhed", tiling.grid(8, 8, 8)["num_qubits"])
    return joined.select("method", F.coalesce("label", F.initcap("method")).alias("label"), F.coalesce("kind", F.lit("Classical")).alias("kind"), _r(F.col("runtime_s") * 1000, "runtime_ms", 2), qubits.alias("qubits"))


@query(f"with m as (select distinct event_type as method from events union all select * from (values ('qhed'), ('canny')) t(method)), {_NAMES_SQL} select method, coalesce(label, upper(method[1]) || lower(method[2:])) as label from m left join l using (method)")
def label_lookup(spark, sf):
    """The same by a map with a default."""
    known = F.create_map(*[F.lit(x) for m, (label, _) in results.LABELS.items() for x in (m, label)])
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("method")).distinct().union(spark.createDataFrame([("qhed",), ("canny",)], "method string"))
    return rows.select("method", F.coalesce(F.try_element_at(known, F.col("method")), F.initcap("method")).alias("label"))


@query(
    _HD + " select first(method order by runtime_s, place) as fastest_method, min(runtime_s) as fastest_runtime_s, first(method order by -f1, place) as highest_f1_method, max(f1) as highest_f1_score, max(runtime_s) filter (where method = 'qhed') as qhed_runtime_s, "
    "max(f1) filter (where method = 'qhed') as qhed_f1, max(megapixels_per_s) filter (where method = 'qhed') as qhed_mp_s, count(*) as total_methods from t"
)
def benchmark_summary(spark, sf):
    place = F.array_position(F.array(*[F.lit(r[0]) for r in results.FULL_HD]), F.col("method"))
    return detection.summary(results.full_hd(spark).withColumn("place", place))


@query(_SW + " select width, height, round(width * height / 1e6, 6) as megapixels, method, runtime_s from t")
def scaling_union(spark, sf):
    parts = [results.sweep(spark).where(F.col("width") == w) for w in (480, 960, 1920, 3840)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("width", "height", _r(F.col("width") * F.col("height") / F.lit(1e6), "megapixels"), "method", "runtime_s")


_PIVOT = ("qhed", "sobel", "canny")


@query(_SW + " select width || 'x' || height as resolution, width, height, " + ", ".join(f"max(runtime_s) filter (where method = '{m}') as {m}_runtime_s, round(width * height / 1e6 / max(runtime_s) filter (where method = '{m}'), 6) as {m}_mp_s" for m in _PIVOT) + " from t group by width, height")
def scaling_pivot(spark, sf):
    rows = results.sweep(spark).withColumn("mp_s", metrics.throughput(F.col("width") * F.col("height") / F.lit(1e6), F.col("runtime_s")))
    p = rows.groupBy("width", "height").pivot("method", list(_PIVOT)).agg(F.first("runtime_s").alias("runtime_s"), F.first("mp_s").alias("mp_s"))
    return p.select(F.concat_ws("x", "width", "height").alias("resolution"), "width", "height", *[c for m in _PIVOT for c in (F.col(f"{m}_runtime_s"), _r(f"{m}_mp_s", f"{m}_mp_s"))])


@query(_SW + " select round(width * height / 1e6, 6) as megapixels, " + ", ".join(f"round(avg(runtime_s) filter (where method = '{m}'), 6) as {m}" for m in _PIVOT) + " from t group by 1")
def runtime_pivot(spark, sf):
    rows = results.sweep(spark).withColumn("megapixels", F.round(F.col("width") * F.col("height") / F.lit(1e6), 6))
    return rows.groupBy("megapixels").pivot("method", list(_PIVOT)).agg(F.avg("runtime_s")).select("megapixels", *[_r(m, m) for m in _PIVOT])


@query(_SW + " select method, round(width * height / 1e6, 6) as megapixels, runtime_s, row_number() over (partition by method order by width * height)::int as place from t order by method, megapixels")
def runtime_ordered(spark, sf):
    from pyspark.sql import Window

    rows = results.sweep(spark).withColumn("megapixels", F.round(F.col("width") * F.col("height") / F.lit(1e6), 6))
    return rows.select("method", "megapixels", "runtime_s", F.row_number().over(Window.partitionBy("method").orderBy("megapixels")).alias("place")).orderBy("method", "megapixels")


@query(_SW + " select method, count(*)::int as n, round(sum(runtime_s), 6) as total_s, min(runtime_s) as least_s, max(runtime_s) as most_s, round(median(runtime_s), 6) as median_s from t group by method")
def grouped_methods(spark, sf):
    g = results.sweep(spark).groupBy("method")
    return g.agg(F.count(F.lit(1)).cast("int").alias("n"), _r(F.sum("runtime_s"), "total_s"), F.min("runtime_s").alias("least_s"), F.max("runtime_s").alias("most_s"), _r(F.median("runtime_s"), "median_s"))


_MORE = [*results.SWEEP, (7680, 4320, "qhed", 6.5), (7680, 4320, "sobel", 0.0)]


@query(
    "with " + _values(_MORE, "width, height, method, runtime_s") + ", p as (select width, height, " + ", ".join(f"coalesce(nullif(max(runtime_s) filter (where method = '{m}'), 0), 0.001) as {m}" for m in _PIVOT)
    + " from t group by width, height) select width, height, round(qhed / sobel, 1) as sobel_speedup, round(qhed / canny, 1) as canny_speedup from p"
)
def scaling_speedups(spark, sf):
    """Ratios; a time that is missing or 0 counts as a thousandth of a second."""
    rows = spark.createDataFrame(_MORE, "width int, height int, method string, runtime_s double")
    p = rows.groupBy("width", "height").pivot("method", list(_PIVOT)).agg(F.first("runtime_s"))
    of = {m: F.coalesce(F.nullif(F.col(m), F.lit(0.0)), F.lit(0.001)) for m in _PIVOT}
    return p.select("width", "height", _r(of["qhed"] / of["sobel"], "sobel_speedup", 1), _r(of["qhed"] / of["canny"], "canny_speedup", 1))


_BOTH = "with " + _values([("full_hd", *r[:2], r[7]) for r in results.FULL_HD] + [("sample", *r[:2], r[7]) for r in results.SAMPLE], "scene, method, runtime_s, f1")


@query(_BOTH + " select scene, method, runtime_s = min(runtime_s) over (partition by scene) as fastest, abs(f1 - max(f1) over (partition by scene)) < 5e-4 as best_f1 from t")
def result_badges(spark, sf):
    """The fastest, and all whose F1 differs from the best by less than 5e-4."""
    from pyspark.sql import Window

    w = Window.partitionBy("scene")
    rows = results.full_hd(spark).withColumn("scene", F.lit("full_hd")).unionByName(results.sample(spark).withColumn("scene", F.lit("sample")))
    return rows.select("scene", "method", (F.col("runtime_s") == F.min("runtime_s").over(w)).alias("fastest"), (F.abs(F.col("f1") - F.max("f1").over(w)) < 5e-4).alias("best_f1"))


@query("with " + _values([(k, str(v)) for k, v in results.CIRCUIT.items()], "name, value") + " select name, value from t")
def circuit_figures(spark, sf):
    return results.circuit_figures(spark)


@query(
    "select o_orderkey, lower(o_orderpriority) as low, upper(o_orderstatus) as up, starts_with(o_orderpriority, '1') as first, split_part(o_orderpriority, '-', 2) as word, regexp_matches(split_part(o_orderpriority, '-', 1), '^[0-9]+$') as digits, "
    "array_to_string(list_transform(string_split(split_part(o_orderpriority, '-', 2), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title, replace(o_orderpriority, '-', '_') as replaced, (o_orderkey % 64)::int as parsed, base64(encode(o_orderpriority)) as coded from orders"
)
def string_functions(spark, sf):
    x = spark.read.parquet(f"{sf}/orders.parquet")
    p, word = F.col("o_orderpriority"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    return x.select(
        "o_orderkey", F.lower(p).alias("low"), F.upper("o_orderstatus").alias("up"), p.startswith("1").alias("first"), word.alias("word"), F.split_part(p, F.lit("-"), F.lit(1)).rlike("^[0-9]+$").alias("digits"),
        F.initcap(word).alias("title"), F.replace(p, F.lit("-"), F.lit("_")).alias("replaced"), F.conv(F.bin(F.col("o_orderkey") % 64), 2, 10).cast("int").alias("parsed"), F.base64(p.cast("binary")).alias("coded"),
    )


@query("select event_id, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::int as k, '{\"event_type\":\"' || event_type || '\",\"k\":' || regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) || '}' as record from events")
def events_json(spark, sf):
    x = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("record"))


_SIZES = [(64, 64, "exact"), (1080, 1920, "exact"), (2160, 3840, "exact"), (2160, 3840, "gpu"), (64, 64, "circuit")]


@query(
    "with " + _values(_SIZES, "h, w, backend") + ", a as (select *, case when backend = 'circuit' then 4 when h * w > 2000000 then 16 else 8 end as tile from t), b as (select *, case when backend = 'circuit' then 32 else greatest(256, least(65536, floor(0.02 * 4294967296 / (tile * tile * 128)))) end as batch0 from a), "
    "c as (select *, case when backend = 'gpu' then greatest(batch0, 4096) else batch0 end as batch from b) select h, w, backend, tile::int as tile_size, batch::int as batch_size, "
    "case when backend = 'gpu' then 1 else greatest(1, least(case when backend = 'circuit' then 4 else 8 end, ceil(ceil(h / (tile - 1.0)) * ceil(w / (tile - 1.0)) / batch))) end::int as partitions from c"
)
def suggested_settings(spark, sf):
    rows = [(h, w, b, *config.suggested_settings(h, w, b).values()) for h, w, b in _SIZES]
    return spark.createDataFrame(rows, "h int, w int, backend string, tile_size int, batch_size int, partitions int")


@query("with t(asked) as (select unnest(range(3, 20))) select asked::int as asked, case when asked in (4, 8, 16) then asked else 8 end::int as tile_size, case when asked % 2 = 0 then asked::int end as shots from t")
def request_settings(spark, sf):
    made = [(n, config.request_config({"tile_size": n, "shots": str(n) if n % 2 == 0 else f"{n}x"})) for n in range(3, 20)]
    return spark.createDataFrame([(n, c.tile_size, c.shots) for n, c in made], "asked int, tile_size int, shots int")


@query(_SW + ", q as (select width, height, runtime_s as q from t where method = 'qhed') select width, height, method, round(q / runtime_s, 6) as speedup, runtime_s = min(runtime_s) over (partition by width, height) as fastest from t join q using (width, height)")
def scaling_badges(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("width", "height")
    s = results.sweep(spark).withColumn("q", F.max(F.when(F.col("method") == "qhed", F.col("runtime_s"))).over(w))
    return s.select("width", "height", "method", _r(F.col("q") / F.col("runtime_s"), "speedup"), (F.col("runtime_s") == F.min("runtime_s").over(w)).alias("fastest"))


@query("""with t(k, v) as (values (1, 0.5::double), (2, 'nan'::double), (3, 'infinity'::double), (4, '-infinity'::double), (5, null))
select case k when 1 then '{"k":1,"v":0.5}' when 2 then '{"k":2,"v":null}' when 3 then '{"k":3,"v":999.0}' when 4 then '{"k":4,"v":-999.0}' else '{"k":5,"v":null}' end as record from t""")
def records_json(spark, sf):
    rows = spark.createDataFrame([(1, 0.5), (2, math.nan), (3, math.inf), (4, -math.inf), (5, None)], "k int, v double")
    return detection.records(rows)


@query("with t(n) as (select unnest(range(1, 11))) select n::int as data_qubits, (n + 1)::int as num_qubits, (n + 3)::int as depth, (n + 4)::int as gate_count from t")
def circuit_metrics(spark, sf):
    return spark.createDataFrame([(n, *circuit.metrics(n).values()) for n in range(1, 11)], "data_qubits int, num_qubits int, depth int, gate_count int")


@query("with t(j) as (select unnest(range(7))) select (j + 2)::int as pos, case when j = 0 then 'x' else 'mcx' end as gate, j::int as n_controls, j::int as target from t union all values (0, 'prepare', 6, 0), (1, 'h', 0, 0), (9, 'h', 0, 0)")
def circuit_gates(spark, sf):
    return spark.createDataFrame([(k, g, len(c), t) for k, (g, c, t) in enumerate(circuit.gates(6))], "pos int, gate string, n_controls int, target int")


@query("values ('circuit', true), ('circuit-noisy', true), ('exact', true), ('gpu', false), ('hardware', false)".replace("values", "select * from (values") + ") t(backend, usable)")
def backend_capabilities(spark, sf):
    return spark.createDataFrame([(n, ok) for n, ok, _ in backends.capabilities(backends.BUILT_IN)], "backend string, usable boolean")


# ------------------------------------------------------------- what SQL can't say

@query(f"{_EV} select image_id, y, x, true as close from px")
def qhed_shots(spark, sf):
    """Sampled magnitudes beside exact ones: 20,000 shots of a tile of 16 leave an error below 0.3, 0.03 on average over an image."""
    from pyspark.sql import Window

    px = rasters.events(spark, sf)
    cores = backends.run_tiles(tiling.split(px, 4), 4, backends.get("circuit", EdgeConfig(shots=20_000, seed=11)))
    error = F.abs(F.col("a") - F.col("b"))
    pairs = metrics.aligned(tiling.stitch(cores, 4), stencils.qhed(px), "m").withColumn("error", error)
    return pairs.select("image_id", "y", "x", ((F.col("error") < 0.3) & (F.avg("error").over(Window.partitionBy("image_id")) < 0.03)).alias("close"))


@query()
def qhed_noisy(spark, sf):
    cores = backends.run_tiles(tiling.split(rasters.events(spark, sf), 4), 4, backends.get("circuit-noisy", EdgeConfig(seed=11)))
    return tiling.stitch(cores, 4).select("image_id", "y", "x", _r("m", "m"))


@query(f"{_EV} select image_id, y, x, floor(least(greatest(v, 0), 1) * 255 + 0.5)::int as level from px")
def png_roundtrip(spark, sf):
    files = images.to_png(rasters.events(spark, sf), "v")
    return images.decode(files).select("image_id", "y", "x", F.round(F.col("v") * 255).cast("int").alias("level"))


@query(f"{_EV} select image_id, y, x, true as close from px")
def jpeg_roundtrip(spark, sf):
    """Byte levels through a JPEG: at a quantiser of 1 they differ by 2 at most."""
    px = rasters.events(spark, sf)
    back = images.decode(images.to_jpeg(px, "v")).select("image_id", "y", "x", F.round(F.col("v") * 255).cast("int").alias("level"))
    joined = back.join(px.select("image_id", "y", "x", post.byte_level(F.col("v")).alias("own")), ["image_id", "y", "x"])
    return joined.select("image_id", "y", "x", (F.abs(F.col("level") - F.col("own")) <= 2).alias("close"))


_TURNED = {1: ("y", "x"), 2: ("y", "w - 1 - x"), 3: ("h - 1 - y", "w - 1 - x"), 4: ("h - 1 - y", "x"), 5: ("x", "y"), 6: ("x", "h - 1 - y"), 7: ("w - 1 - x", "h - 1 - y"), 8: ("w - 1 - x", "y")}


@query(f"{_EV} " + " union all ".join(f"select image_id, {t} as tag, ({y})::int as y, ({x})::int as x, floor(least(greatest(v, 0), 1) * 255 + 0.5)::int as level from px" for t, (y, x) in _TURNED.items()))
def orientation(spark, sf):
    px, out = rasters.events(spark, sf), None
    for tag in range(1, 9):
        back = images.decode(images.to_png(px, "v", tag)).select("image_id", F.lit(tag).alias("tag"), "y", "x", F.round(F.col("v") * 255).cast("int").alias("level"))
        out = back if out is None else out.unionByName(back)
    return out


_CHANNELS = {"r": (20, 3), "g": (7, 11), "b": (13, 5), "a": (25, 9)}
_WHITE = lambda c: f"round_even({c} * (a / 255.0::double) + 255.0::double * (1 - a / 255.0::double), 0)::bigint"
_LUMA = "(({0} * 19595 + {1} * 38470 + {2} * 7471 + 32768) >> 16)"


@query(
    "with p as (select (k // 10)::bigint as y, (k % 10)::bigint as x from range(120) t(k)), c as (select y, x, " + ", ".join(f"(y * {i} + x * {j}) % 256 as {c}" for c, (i, j) in _CHANNELS.items()) + " from p), v as ("
    "select 'deep' as image_id, y, x, (y * 4096 + x * 100) / 65535.0::double as v from c union all "
    f"select 'rgb', y, x, {_LUMA.format('r', 'g', 'b')} / 255.0::double from c union all select 'rgba', y, x, {_LUMA.format(_WHITE('r'), _WHITE('g'), _WHITE('b'))} / 255.0::double from c union all "
    f"select 'grey_alpha', y, x, {_WHITE('r')} / 255.0::double from c) select image_id, y::int as y, x::int as x, round(v, 6) as v from v"
)
def png_kinds(spark, sf):
    """16-bit grey, RGB, and RGB and grey with alpha over white, as intensities."""
    import numpy as np

    y, x = np.mgrid[0:12, 0:10]
    of = {c: ((y * i + x * j) % 256).astype(np.uint8) for c, (i, j) in _CHANNELS.items()}
    made = {"deep": (y * 4096 + x * 100).astype(np.uint16), "rgb": np.dstack([of[c] for c in "rgb"]), "rgba": np.dstack([of[c] for c in "rgba"]), "grey_alpha": np.dstack([of["r"], of["a"]])}
    files = spark.createDataFrame([(k, bytearray(png.encode(v))) for k, v in made.items()], "image_id string, content binary")
    return images.decode(files).select("image_id", "y", "x", _r("v", "v"))


@query(f"{_EV} select image_id, y, x, floor(least(greatest(v, 0), 1) * 255 + 0.5)::int as level, true as is_url from px")
def data_url(spark, sf):
    """A PNG as a data URL and back."""
    urls = images.to_png(rasters.events(spark, sf), "v").select("image_id", images.data_url(F.col("content")).alias("url"))
    files = urls.select(F.concat("image_id", F.lit("|"), F.col("url").startswith("data:image/png;base64,").cast("string")).alias("image_id"), images.content_of(F.col("url")).alias("content"))
    back = images.decode(files)
    return back.select(F.split_part("image_id", F.lit("|"), F.lit(1)).alias("image_id"), "y", "x", F.round(F.col("v") * 255).cast("int").alias("level"), (F.split_part("image_id", F.lit("|"), F.lit(2)) == "true").alias("is_url"))


@query(
    "select * from (values ('empty', 'empty file'), ('junk', 'not a readable PNG or JPEG image'), ('gif', 'unsupported format GIF'), ('good', null), ('thin', 'smaller than 2 pixels'), ('wide', 'larger than 3840x2160'), ('cut', 'truncated or damaged'), "
    "('photo', null), ('cut_photo', 'truncated or damaged'), ('bomb', 'too many pixels')) t(image_id, error)"
)
def upload_validation(spark, sf):
    import struct

    import numpy as np

    levels = np.arange(24, dtype=np.uint8).reshape(4, 6)
    good, photo = png.encode(levels), jpeg.encode_grey(np.kron(levels, np.ones((9, 9))))
    made = {
        "empty": b"", "junk": b"junk", "gif": b"GIF89a" + bytes([9, 0, 9, 0]) + bytes(20), "good": good, "cut": good[:-20], "photo": photo, "cut_photo": photo[: len(photo) - 40],
        "thin": png.encode(np.zeros((1, 50), np.uint8)), "wide": png.encode(np.zeros((3, 3841), np.uint8)), "bomb": good[:16] + struct.pack(">II", 60_000, 60_000) + good[24:],
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "image_id string, content binary")
    return images.validate(files).select("image_id", "error")


_PX = f"{_SCENE}, px as (select 'scene' as image_id, 96 as h, 128 as w, y, x, {_LEVEL} as v from l)"
_TRUTH = "truth as (select y, x, coalesce(label <> lead(label) over (partition by y order by x), false) or coalesce(label <> lead(label) over (partition by x order by y), false) as e from l)"
_DETECTED = " union all ".join(f"select '{m}' as method, y, x, m, {over} as e from {t}" for m, t, over in (("qhed", "qn", "m >= 0.2"), ("sobel", "sn", "m >= 0.2"), ("prewitt", "wn", "m >= 0.2"), ("laplacian", "ln", "m >= 0.2"), ("canny", "cm", "m >= 0.2")))
_NEAR = "(p.y - r.y) * (p.y - r.y) + (p.x - r.x) * (p.x - r.x) <= 1"
_BENCHMARK = (
    f"{_PX}, {_TRUTH}, {_QN}, {_two_pass(2.0)}, {_two_pass(1.0, 'w')}, {_LAPLACIAN}, {_CANNY}, det as ({_DETECTED}), both_ as (select method, y, x, m, d.e as p, t.e as r from det d join truth t using (y, x)), "
    "figures as (select method, 10 * log10(1 / avg((m - r::int) * (m - r::int))) as psnr, avg(p::int) as edge_density, count(*) filter (where p and r) / count(*) filter (where p or r) as iou, count(*) filter (where p) as np, count(*) filter (where r) as nr from both_ group by method), "
    f"hits as (select f.method, (select count(*) from both_ p where p.method = f.method and p.p and exists (select 1 from both_ r where r.method = p.method and r.r and {_NEAR})) as hp, "
    f"(select count(*) from both_ p where p.method = f.method and p.r and exists (select 1 from both_ r where r.method = p.method and r.p and {_NEAR})) as hr from figures f), "
    'scored as (select *, hp / np as "precision", hr / nr as recall from figures join hits using (method)) '
    'select method, round(psnr, 5) as psnr, round("precision", 5) as "precision", round(recall, 5) as recall, round(2 * "precision" * recall / ("precision" + recall), 5) as f1, round(iou, 5) as iou, round(edge_density, 5) as edge_density, true as timed from scored'
)


@query(_BENCHMARK.replace("with ", "with recursive ", 1))
def benchmark_rows(spark, sf):
    """All methods on the scene against its boundaries; times differ from run to run, so only whether there are any is told."""
    s = synthetic.scene(spark, 96, 128)
    rows = detection.benchmark(s.select("image_id", "h", "w", "y", "x", "v"), 96, 128, stencils.label_edges(s))
    timed = (F.col("runtime_s") > 0) & (F.col("megapixels_per_s") > 0) & (F.col("tiles_per_s").isNotNull() == (F.col("method") == "qhed"))
    return rows.select("method", *[_r(c, c, 5) for c in ("psnr", "precision", "recall", "f1", "iou", "edge_density")], timed.alias("timed"))


@query("select * from (values (16, 24, 0.000384::double, 'qhed', true), (16, 24, 0.000384, 'sobel', true), (32, 48, 0.001536, 'qhed', true), (32, 48, 0.001536, 'sobel', true)) t(height, width, megapixels, method, timed)")
def measured_scaling(spark, sf):
    rows = detection.scaling(spark, ((16, 24), (32, 48)), ("qhed", "sobel"))
    timed = (F.col("runtime_s") > 0) & (F.abs(F.col("megapixels_per_s") * F.col("runtime_s") - F.col("megapixels")) < 1e-9)
    return rows.select("height", "width", _r("megapixels", "megapixels"), "method", timed.alias("timed"))


_4K = (2160, 3840)
_LABEL_4K = synthetic.label_sql(*_4K)
_VALUE = lambda c: _LEVEL.replace("case label", f"case {c}")


@query(
    f"with p as (select (k // 3840)::int as y0, (k % 3840)::int as x0 from range(2160 * 3840) t(k)), a as (select y0, x0, y0 as y, x0 as x, {_LABEL_4K.replace('y /', 'y0 /').replace('x /', 'x0 /')} as la from p), "
    f"b as (select y0, x0, la, {_LABEL_4K} as lb from (select y0, x0, la, y0 as y, least(x0 + 1, 3839) as x from a)), c as (select la, lb, {_LABEL_4K} as lc from (select la, lb, least(y0 + 1, 2159) as y, x0 as x from b)), "
    f"v as (select {_VALUE('la')} as va, {_VALUE('lb')} as vb, {_VALUE('lc')} as vc from c), m as (select sqrt((va - vb) * (va - vb) + (va - vc) * (va - vc)) as m from v), top as (select max(m) as peak from m) "
    "select 'scene' as image_id, round(peak, 6) as peak, count(*) filter (where m >= 0.2 * peak) as n_edges from m, top group by peak"
)
def qhed_4k(spark, sf):
    """The scene at 3840 x 2160 in strips: peak and number of edge pixels."""
    rows = -(-_4K[0] // (2 * spark.sparkContext.defaultParallelism))  # two strips for each core
    return strips.detected_counts(strips.scene(spark, *_4K, rows), 0.2).select("image_id", _r("peak", "peak"), "n_edges")
