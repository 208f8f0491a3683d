"""Queries: region graphs of rasters, diffusion, merging, descriptors, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import geometry as G
from geoquarry.operators import quality
from geoquarry.operators import regions as R
from geoquarry.operators import tokens as K
from geoquarry.plans.q_boxes import _six, six
from geoquarry.plans.queries import query
from geoquarry.plans.views import RASTER, raster

COLOURS = ["v"]


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, nodes with temperatures, and conductivities of the rasters."""
    px = raster(spark, d).withColumn("grad", F.abs("v"))
    edges = R.adjacency(px)
    nodes = R.temperatures(R.features(px, COLOURS, "grad"), edges, COLOURS, 1.0)
    return edges, nodes, R.conductivity(nodes, edges, COLOURS, 1.0, 1.0, 0.1)


@query(f"WITH {RASTER} SELECT image_id, src, dst FROM edges")
def raster_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return R.adjacency(raster(spark, d))


@query(f"WITH {RASTER} SELECT image_id, region, size, {_six('c')} AS v, {_six('complexity')} AS complexity FROM nodes")
def region_features(spark: SparkSession, d: str) -> DataFrame:
    n = R.features(raster(spark, d).withColumn("grad", F.abs("v")), COLOURS, "grad")
    return n.select("image_id", "region", "size", six(F.col("v")).alias("v"), six(F.col("complexity")).alias("complexity"))


@query(f"WITH {RASTER} SELECT image_id, region, {_six('temp')} AS temp FROM temps")
def region_temperature(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("image_id", "region", six(F.col("temp")).alias("temp"))


@query(f"WITH {RASTER} SELECT image_id, src, dst, {_six('k')} AS k FROM cond")
def edge_conductivity(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[2].select("image_id", "src", "dst", six(F.col("k")).alias("k"))


_STEP = """flow AS (SELECT e.image_id, e.src AS region, sum(e.k * t.temp) AS i, sum(e.k) AS g FROM (SELECT image_id, src, dst, k FROM cond UNION ALL SELECT image_id, dst, src, k FROM cond) e
  JOIN temps t ON t.image_id = e.image_id AND t.region = e.dst GROUP BY ALL),
one AS (SELECT t.image_id, t.region, t.temp + 0.1 * (coalesce(i, 0) - t.temp * coalesce(g, 0)) AS temp FROM temps t LEFT JOIN flow USING (image_id, region))"""


@query(f"WITH {RASTER}, {_STEP} SELECT image_id, region, {_six('temp')} AS temp FROM one")
def diffuse_one_step(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, k = _graph(spark, d)
    return R.diffuse_once(nodes, k, 0.1).select("image_id", "region", six(F.col("temp")).alias("temp"))


def _steps(n: int) -> str:
    """``n`` steps as a chain of tables; an image whose step is below the limit keeps its temperatures."""
    out, last = [], "temps"
    for i in range(n):
        out.append(f"""f{i} AS (SELECT t.image_id, t.region, t.temp, 0.1 * (coalesce(sum(e.k * o.temp), 0) - t.temp * coalesce(sum(e.k), 0)) AS step FROM {last} t
  LEFT JOIN both_k e ON e.image_id = t.image_id AND e.src = t.region LEFT JOIN {last} o ON o.image_id = e.image_id AND o.region = e.dst GROUP BY t.image_id, t.region, t.temp),
t{i} AS (SELECT image_id, region, CASE WHEN max(abs(step)) OVER (PARTITION BY image_id) < 1e-5 THEN temp ELSE temp + step END AS temp FROM f{i})""")
        last = f"t{i}"
    return "both_k AS (SELECT image_id, src, dst, k FROM cond UNION ALL SELECT image_id, dst, src, k FROM cond), " + ", ".join(out)


@query(f"WITH {RASTER}, {_steps(6)} SELECT image_id, region, {_six('temp')} AS temp FROM t5")
def diffuse_n_steps(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, k = _graph(spark, d)
    return R.diffuse(nodes, k, 0.1, 6).select("image_id", "region", six(F.col("temp")).alias("temp"))


@query(f"""WITH RECURSIVE {RASTER}, near AS (SELECT b.image_id, b.src, b.dst FROM both_ways b JOIN temps s ON s.image_id = b.image_id AND s.region = b.src JOIN temps t ON t.image_id = b.image_id AND t.region = b.dst WHERE abs(s.temp - t.temp) < 0.05),
r(image_id, region, root) AS (SELECT image_id, region, region FROM temps UNION SELECT n.image_id, n.dst, r.root FROM r JOIN near n ON n.image_id = r.image_id AND n.src = r.region),
m AS (SELECT image_id, region, min(root) AS root FROM r GROUP BY ALL) SELECT image_id, region, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INTEGER) AS merged FROM m""")
def merge_components(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes, _ = _graph(spark, d)
    return R.merge(nodes, edges, 0.05)


@query(f"""WITH {RASTER} SELECT b.image_id, b.src AS region, b.dst AS target FROM both_ways b JOIN nodes s ON s.image_id = b.image_id AND s.region = b.src JOIN nodes t ON t.image_id = b.image_id AND t.region = b.dst
WHERE s.size < 6 AND t.size >= 6 QUALIFY row_number() OVER (PARTITION BY b.image_id, b.src ORDER BY sqrt((s.c - t.c) * (s.c - t.c)), b.dst) = 1""")
def min_size_round(spark: SparkSession, d: str) -> DataFrame:
    return R.min_size_round(raster(spark, d), COLOURS, 6)


@query()
def max_size_split(spark: SparkSession, d: str) -> DataFrame:
    return R.split_large(raster(spark, d), 24, 8)


@query(f"""WITH {RASTER}, f AS (SELECT image_id, y, x, CASE WHEN label <> 0 THEN label END AS label FROM raster),
k AS (SELECT g.image_id, g.y, g.x, arg_min(n.label, (n.y - g.y) * (n.y - g.y) + (n.x - g.x) * (n.x - g.x) + (n.y * 8 + n.x) / 1000.0) AS label
  FROM f g JOIN f n ON g.image_id = n.image_id WHERE g.label IS NULL AND n.label IS NOT NULL GROUP BY ALL)
SELECT f.image_id, f.y, f.x, coalesce(f.label, k.label, -1) AS label FROM f LEFT JOIN k USING (image_id, y, x)""")
def fill_unassigned(spark: SparkSession, d: str) -> DataFrame:
    return R.fill_unassigned(raster(spark, d).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label"))))


_GAUSS = """g AS (SELECT image_id, label AS region, avg(x) AS mu_x, avg(y) AS mu_y, sqrt(greatest(var_pop(x), 1e-6)) AS sx, sqrt(greatest(var_pop(y), 1e-6)) AS sy, covar_pop(x, y) AS c, count(*) AS size FROM raster WHERE label >= 0 GROUP BY ALL),
h AS (SELECT *, greatest(least(c / (sx * sy), 0.999), -0.999) AS rho FROM g)"""


@query(f"WITH {RASTER}, {_GAUSS} SELECT image_id, region, {_six('mu_x')} AS mu_x, {_six('mu_y')} AS mu_y, {_six('sx')} AS sigma_x, {_six('sy')} AS sigma_y, {_six('rho')} AS rho, size FROM h")
def gaussian_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return R.gaussians(raster(spark, d)).select("image_id", "region", *[six(F.col(c)).alias(c) for c in ("mu_x", "mu_y", "sigma_x", "sigma_y", "rho")], "size")


@query(f"WITH {RASTER}, {_GAUSS} SELECT image_id, region, CASE WHEN abs(sx * sx - sy * sy) <= 1e-6 THEN 0.0 ELSE {_six('0.5 * atan2(2 * rho * sx * sy, sx * sx - sy * sy)')} END AS phi FROM h")
def orientation(spark: SparkSession, d: str) -> DataFrame:
    phi = G.orientation(F.col("sigma_x"), F.col("sigma_y"), F.col("rho"))
    return R.gaussians(raster(spark, d)).select("image_id", "region", six(phi).alias("phi"))


_QUANT = "CAST(least(greatest(round_even({0} * 4095, 0), 0), 4095) AS INTEGER)"


@query(f"""WITH {RASTER}, {_GAUSS} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY region) - 1 AS INTEGER) AS token_idx, {_QUANT.format('mu_y / 8')} AS pos_y, {_QUANT.format('mu_x / 8')} AS pos_x,
 {_QUANT.format('least(greatest(2 * sy / 8, 0.0), 1.0)')} AS ext_y, {_QUANT.format('least(greatest(2 * sx / 8, 0.0), 1.0)')} AS ext_x FROM h""")
def quantize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return K.region_tokens(R.gaussians(raster(spark, d)), 8, 8).select("image_id", "token_idx", "pos_y", "pos_x", "ext_y", "ext_x")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.tables import table

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.lit(100) + F.col("vec_id") % 57).alias("w"), (F.lit(90) + F.col("vec_id") % 41).alias("h"))


@query(f"""WITH i AS (SELECT vec_id AS image_id, CAST(ceil((100 + vec_id % 57) / 56) AS INTEGER) AS c, CAST(ceil((90 + vec_id % 41) / 56) AS INTEGER) AS r FROM embeddings),
k AS (SELECT image_id, r, c, unnest(range(r * c)) AS token_idx FROM i)
SELECT image_id, CAST(token_idx AS INTEGER) AS token_idx, {_QUANT.format('((token_idx // c + 0.5) / r)')} AS pos_y, {_QUANT.format('((token_idx % c + 0.5) / c)')} AS pos_x, {_QUANT.format('(1 / r)')} AS ext_y, {_QUANT.format('(1 / c)')} AS ext_x FROM k""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return K.tile_tokens(_sizes(spark, d), "w", "h").select("image_id", F.col("token_idx").cast("int").alias("token_idx"), "pos_y", "pos_x", "ext_y", "ext_x")


@query(f"""WITH {RASTER}, {_GAUSS}, t AS (SELECT image_id, region, {_QUANT.format('mu_y / 8')} AS cy, {_QUANT.format('mu_x / 8')} AS cx, {_QUANT.format('least(greatest(2 * sy / 8, 0.0), 1.0)')} AS ey, {_QUANT.format('least(greatest(2 * sx / 8, 0.0), 1.0)')} AS ex,
 CASE WHEN abs(sx * sx - sy * sy) <= 1e-6 THEN 0.0 ELSE 0.5 * atan2(2 * rho * sx * sy, sx * sx - sy * sy) END AS phi FROM h),
u AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY region) - 1 AS INTEGER) AS token_idx, cy * cos(phi) + cx * sin(phi) AS c, ey * cos(phi) + ex * sin(phi) AS e FROM t)
SELECT image_id, token_idx, m, round((1 - m / 3.0) * cos(c * pow(10000.0, -2 * m / 8.0)) + (m / 3.0) * cos(e * pow(10000.0, -2 * m / 8.0)), 4) AS weight FROM u CROSS JOIN range(4) r(m)""")
def gmrope_weights(spark: SparkSession, d: str) -> DataFrame:
    t = K.rotary_weights(K.region_tokens(R.gaussians(raster(spark, d)), 8, 8), 8)
    return t.select("image_id", "token_idx", F.posexplode("weights").alias("m", "w")).select("image_id", "token_idx", F.col("m").cast("long").alias("m"), F.round("w", 4).alias("weight"))


@query(f"""WITH {RASTER}, s AS (SELECT image_id, x * 8 + y AS i, CASE WHEN label >= 3 THEN 1 ELSE 0 END AS m FROM raster),
g AS (SELECT *, i - row_number() OVER (PARTITION BY image_id, m ORDER BY i) AS k FROM s),
r AS (SELECT image_id, m, min(i) AS b, count(*) AS n FROM g GROUP BY image_id, m, k)
SELECT image_id, CASE WHEN arg_min(m, b) = 1 THEN '0 ' ELSE '' END || string_agg(CAST(n AS VARCHAR), ' ' ORDER BY b) AS counts, CAST(sum(m * n) AS INTEGER) AS area FROM r GROUP BY image_id""")
def rle_encode(spark: SparkSession, d: str) -> DataFrame:
    runs = quality.run_lengths(raster(spark, d), F.col("label") >= 3)
    return runs.select("image_id", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"), "area")


_MASKS = """mk AS (SELECT image_id, m AS mask_id, y, x FROM raster CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE label >= m OR (m = 4 AND y < 3)),
sz AS (SELECT image_id, mask_id, count(*) AS area FROM mk GROUP BY ALL)"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    px = raster(spark, d).select("image_id", "y", "x", "label", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("mask_id"))
    return px.where((F.col("label") >= F.col("mask_id")) | ((F.col("mask_id") == 4) & (F.col("y") < 3))).select("image_id", "mask_id", "y", "x")


@query(f"""WITH {RASTER}, {_MASKS}, sh AS (SELECT a.image_id, a.mask_id, b.mask_id AS o, count(*) AS n, any_value(sa.area) AS area FROM mk a JOIN mk b USING (image_id, y, x) JOIN sz sa ON sa.image_id = a.image_id AND sa.mask_id = a.mask_id
  JOIN sz sb ON sb.image_id = b.image_id AND sb.mask_id = b.mask_id WHERE sb.area > sa.area GROUP BY ALL)
SELECT mk.image_id, mk.mask_id, mk.y, mk.x FROM mk ANTI JOIN (SELECT DISTINCT image_id, mask_id FROM sh WHERE n / area > 0.8) g USING (image_id, mask_id)""")
def mask_filter_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.covered_masks(_masks(spark, d)).select("image_id", "mask_id", "y", "x")


@query(f"""WITH {RASTER}, {_MASKS}, k AS (SELECT image_id, mask_id, row_number() OVER (PARTITION BY image_id ORDER BY area, mask_id) - 1 AS l FROM sz)
SELECT mk.image_id, mk.y, mk.x, CAST(max(k.l) AS INTEGER) AS label FROM mk JOIN k USING (image_id, mask_id) GROUP BY ALL""")
def paint_masks(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    return R.paint(m.join(m.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area")), ["image_id", "mask_id"]))


@query(f"""WITH {RASTER}, {_MASKS} SELECT a.image_id, a.mask_id AS a, b.mask_id AS b, {_six('count(*) / (any_value(sa.area) + any_value(sb.area) - count(*) + 1e-7)')} AS iou
FROM mk a JOIN mk b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x JOIN sz sa ON sa.image_id = a.image_id AND sa.mask_id = a.mask_id JOIN sz sb ON sb.image_id = b.image_id AND sb.mask_id = b.mask_id GROUP BY a.image_id, a.mask_id, b.mask_id""")
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    return R.mask_ious(m, m).select("image_id", "a", "b", six(F.col("iou")).alias("iou"))


@query(f"WITH {RASTER} SELECT image_id, {_six('count(*) FILTER (v > 0.05) / nullif(count(*) FILTER (v > -0.05), 0)')} AS stability FROM raster GROUP BY image_id")
def stability_score(spark: SparkSession, d: str) -> DataFrame:
    return R.stability(raster(spark, d), ["image_id"], "v", 0.0, 0.05).select("image_id", six(F.col("stability")).alias("stability"))


@query(f"WITH {RASTER} SELECT image_id, label AS region, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM raster GROUP BY ALL")
def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    return R.boxes(raster(spark, d))


@query(f"""WITH {RASTER}, q AS (SELECT r.image_id, r.y, r.x,
 sum(CASE n.x - r.x WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * CASE WHEN n.y = r.y THEN 2 ELSE 1 END * n.v) AS gx, sum(CASE n.y - r.y WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * CASE WHEN n.x = r.x THEN 2 ELSE 1 END * n.v) AS gy
 FROM raster r JOIN raster n ON n.image_id = r.image_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1 GROUP BY ALL) SELECT image_id, y, x, {_six('sqrt(gx * gx + gy * gy)')} AS grad FROM q""")
def sobel_gradient(spark: SparkSession, d: str) -> DataFrame:
    return R.gradient(raster(spark, d), "v").select("image_id", "y", "x", six(F.col("grad")).alias("grad"))


@query()
def region_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return R.pipeline(raster(spark, d), COLOURS)


@query(f"""WITH {RASTER}, {_GAUSS}, n AS (SELECT image_id, count(*) AS n FROM h GROUP BY image_id) SELECT image_id, CAST(ceil(n / 4) AS INTEGER) AS n_total FROM n""")
def padded_token_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = K.padded(K.region_tokens(R.gaussians(raster(spark, d)), 8, 8))
    return K.token_counts(tokens).select("image_id", "n_total")


@query(f"WITH {RASTER} SELECT 'pipeline' AS step, image_id, count(*) AS pixels FROM raster GROUP BY image_id UNION ALL SELECT 'split', image_id, count(*) FROM raster GROUP BY image_id")
def region_totals(spark: SparkSession, d: str) -> DataFrame:
    """No pixel is lost on the way: the regions' sizes add up to the image after the whole pipeline and after the split."""
    whole = R.pipeline(raster(spark, d), COLOURS).groupBy("image_id").agg(F.sum("size").alias("pixels"))
    split = R.split_large(raster(spark, d), 24, 8).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"))
    return whole.select(F.lit("pipeline").alias("step"), "image_id", "pixels").unionByName(split.select(F.lit("split").alias("step"), "image_id", "pixels"))
