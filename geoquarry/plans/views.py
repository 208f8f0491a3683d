"""Stand-in views: driver tables in the shapes the operators take, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquarry.tables import table

TURN = "array<struct<from:string,value:string>>"


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    """ann_id, messages and images: question and answer turns of an image, some led by a system turn, some broken."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    pairs = F.flatten(F.transform(F.coalesce("qa_pairs", F.array().cast("array<struct<ques_id:int,question:string,type:string,answer:string>>")), lambda q: F.array(turn("human", q["question"]), turn("gpt", q["answer"]))))
    turns = F.when(F.col("ann_id") % 11 == 0, F.reverse(pairs)).otherwise(pairs)
    lead = F.when(F.col("ann_id") % 5 == 0, F.array(turn("system", F.coalesce("caption", F.lit("")))).cast(TURN)).otherwise(F.array().cast(TURN))
    whole = F.concat(lead, turns.cast(TURN))
    cut = F.when((F.col("ann_id") % 7 == 0) & (F.size(whole) > 0), F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))).otherwise(whole)
    return table(spark, d, "annotations").select("ann_id", cut.alias("messages"), F.array("image").alias("images"))


DIALOGUES = """dlg0 AS (
  SELECT ann_id, image, list_concat(
    CASE WHEN ann_id % 5 = 0 THEN [{'from': 'system', 'value': coalesce(caption, '')}] ELSE [] END,
    CASE WHEN ann_id % 11 = 0 THEN list_reverse(flatten(list_transform(coalesce(qa_pairs, []), lambda q: [{'from': 'human', 'value': q.question}, {'from': 'gpt', 'value': q.answer}])))
         ELSE flatten(list_transform(coalesce(qa_pairs, []), lambda q: [{'from': 'human', 'value': q.question}, {'from': 'gpt', 'value': q.answer}])) END) AS m
  FROM annotations),
dlg AS (SELECT ann_id, image, CASE WHEN ann_id % 7 = 0 AND len(m) > 0 THEN m[1:len(m) - 1] ELSE m END AS messages FROM dlg0),
chat AS (
  SELECT ann_id, messages, CASE WHEN len(messages) > 0 AND messages[1]['from'] = 'system' THEN messages[1]['value'] ELSE '' END AS sys,
         CASE WHEN len(messages) > 0 AND messages[1]['from'] = 'system' THEN messages[2:] ELSE messages END AS body FROM dlg),
ok AS (
  SELECT *, len(body) > 0 AND len(body) % 2 = 0 AND len(list_filter(body, lambda x, i: x['from'] <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) = 0 AS valid FROM chat),
roled AS (
  SELECT ann_id, sys, valid, CASE WHEN valid THEN list_transform(body, lambda x: {'role': CASE x['from'] WHEN 'human' THEN 'user' ELSE 'assistant' END, 'content': x['value']}) ELSE [] END AS turns FROM ok)"""


def halves(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, prompt (first line), response (what follows it) and tag (a long text) of every document that has a text."""
    docs = table(spark, d, "documents").where("text is not null")
    first = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", "source", first.alias("prompt"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("response"), (F.col("n_chars") >= 600).alias("tag"))


HALVES = """halves AS (
  SELECT doc_id, source, split_part(text, chr(10), 1) AS prompt, substr(text, length(split_part(text, chr(10), 1)) + 2) AS response, n_chars >= 600 AS tag
  FROM documents WHERE text IS NOT NULL)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of eight orders as an image: image_id, box_id (in the image), corners, conf, cls and side."""
    image = F.floor(F.col("l_orderkey") / 8)
    order = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("image_id", image)
    x1, y1 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return rows.select(
        "image_id",
        F.row_number().over(order).cast("long").alias("box_id"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 10 + F.col("l_quantity")).alias("x2"),
        (y1 + 10 + F.round(F.col("l_discount") * 100)).alias("y2"),
        F.least(F.floor(F.col("l_extendedprice") * 10 + 0.5) / 1e6, F.lit(1.0)).alias("conf"),
        (F.col("l_linenumber") % 3).cast("int").alias("cls"),
        F.when(F.col("l_returnflag") == "R", "gt").otherwise("det").alias("side"),
    )


BOXES = """boxes AS MATERIALIZED (
  SELECT l_orderkey // 8 AS image_id,
         row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id,
         CAST(l_partkey % 40 AS DOUBLE) AS x1, CAST(l_suppkey % 40 AS DOUBLE) AS y1,
         CAST(l_partkey % 40 AS DOUBLE) + 10 + l_quantity AS x2, CAST(l_suppkey % 40 AS DOUBLE) + 10 + round(l_discount * 100) AS y2,
         least(floor(l_extendedprice * 10 + 0.5) / 1e6, 1.0) AS conf, CAST(l_linenumber % 3 AS INTEGER) AS cls,
         CASE WHEN l_returnflag = 'R' THEN 'gt' ELSE 'det' END AS side
  FROM lineitem),
det AS MATERIALIZED (SELECT image_id, box_id AS det_id, x1, y1, x2, y2, conf, cls FROM boxes WHERE side = 'det'),
gt AS MATERIALIZED (SELECT image_id, box_id AS gt_id, x1, y1, x2, y2, cls FROM boxes WHERE side = 'gt')"""


def detections(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).where("side = 'det'").withColumnRenamed("box_id", "det_id").drop("side")


def truths(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).where("side = 'gt'").withColumnRenamed("box_id", "gt_id").drop("side", "conf")


def overlap_sql(a: str, b: str) -> str:
    """IoU of two aliases' boxes."""
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0)"
    area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"({inter}) / ({area(a)} + {area(b)} - ({inter}) + 1e-7)"


def raster(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 by 8 images: image_id, y, x, label (from 0) and v, the value as a one-channel colour."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "f"))
    v = F.col("f").cast("double")
    return rows.select("image_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), (F.floor(v * 4) + 3).cast("int").alias("label"), v.alias("v"))


RASTER = """raster AS (
  SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(floor(CAST(f AS DOUBLE) * 4) AS INTEGER) + 3 AS label, CAST(f AS DOUBLE) AS v
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS f FROM embeddings)),
pairs AS (
  SELECT a.image_id, a.label AS l, b.label AS o FROM raster a JOIN raster b ON a.image_id = b.image_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))
  WHERE a.label >= 0 AND b.label >= 0 AND a.label <> b.label),
edges AS (SELECT DISTINCT image_id, least(l, o) AS src, greatest(l, o) AS dst FROM pairs),
both_ways AS (SELECT image_id, src, dst FROM edges UNION ALL SELECT image_id, dst, src FROM edges),
nodes AS (SELECT image_id, label AS region, count(*) AS size, avg(v) AS c, avg(abs(v)) AS complexity FROM raster WHERE label >= 0 GROUP BY ALL),
temps AS (
  SELECT n.image_id, n.region, coalesce(t.temp, 0.0) AS temp FROM nodes n LEFT JOIN (
    SELECT e.image_id, e.src AS region, avg(exp(-abs(s.c - d.c) / 1.0)) AS temp FROM both_ways e
    JOIN nodes s ON s.image_id = e.image_id AND s.region = e.src JOIN nodes d ON d.image_id = e.image_id AND d.region = e.dst GROUP BY ALL) t USING (image_id, region)),
cond AS (
  SELECT e.image_id, e.src, e.dst, 1.0 * exp(-(s.c - d.c) * (s.c - d.c) / 2.0) * (1 + 0.1 * least(s.complexity, d.complexity)) AS k
  FROM edges e JOIN nodes s ON s.image_id = e.image_id AND s.region = e.src JOIN nodes d ON d.image_id = e.image_id AND d.region = e.dst)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as detections of user streams, in order of time: stream_id, frame_id, det_id, corners, conf, cls."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order)
    at = F.col("value") % 20
    rows = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("stream_id"), n.alias("frame_id"), F.col("event_id").alias("det_id"), at.alias("x1"), at.alias("y1"), (F.col("value") % 7 / 10 + 0.3).alias("conf"))
    return rows.select("stream_id", "frame_id", "det_id", "x1", "y1", (F.col("x1") + 30).alias("x2"), (F.col("y1") + 30).alias("y2"), "conf", F.lit(0).alias("cls"))


def texts(column: Column) -> Column:
    """Aligned turns as one text for comparison."""
    return F.array_join(F.transform(column, lambda m: F.concat(m["role"], F.lit("="), F.coalesce(m["content"], F.lit("")))), "|")
