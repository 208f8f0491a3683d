"""Queries: choices, accuracies, text scores, smoothing, clipping, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import textscore as S
from geoquarry.operators import metrics as M
from geoquarry.operators import quality
from geoquarry.plans.q_boxes import _six, six
from geoquarry.plans.queries import query
from geoquarry.tables import table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("s", F.col("embedding").cast("array<double>"))


_E = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"""WITH {_E}, r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e)
SELECT {_six('avg(CASE WHEN h1 THEN 1.0 ELSE 0.0 END)')} AS top1, {_six('avg(CASE WHEN h5 THEN 1.0 ELSE 0.0 END)')} AS top5 FROM (SELECT vec_id, bool_or(k = 1 AND i = label) AS h1, bool_or(k <= 5 AND i = label) AS h5 FROM r GROUP BY vec_id)""")
def top1_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).select("label", M.top_classes(F.col("s"), 5).alias("ranked"))
    return M.topk_accuracy(rows, "ranked", "label").select(*[six(F.col(c)).alias(c) for c in ("top1", "top5")])


@query(f"""WITH {_E}, c AS (SELECT vec_id, label, arg_max(i, (v, -i)) AS best FROM e WHERE i < 4 GROUP BY ALL), t AS (SELECT CAST(label AS VARCHAR) AS category, best = label % 4 AS ok FROM c)
SELECT category, {_six('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM t GROUP BY category UNION ALL SELECT 'Average', {_six('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')}, count(*) FROM t""")
def choice_accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    letter = M.choice(F.slice("s", 1, 4))
    truth = F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("label") % 4 + 1).cast("int"))
    rows = _scores(spark, d).select(F.col("label").cast("string").alias("category"), (letter == truth).alias("ok"))
    return M.choice_accuracy(rows, "category", F.col("ok")).select("category", six(F.col("accuracy")).alias("accuracy"), "n")


_TOK = """t AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 4) AS INTEGER)) AS lab, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 5) AS INTEGER)) AS pre FROM embeddings),
u AS (SELECT vec_id, unnest(range(1, len(lab))) AS i, lab, pre FROM t), w AS (SELECT vec_id, CASE WHEN lab[i + 1] = -1 THEN NULL ELSE lab[i + 1] = pre[i] END AS hit FROM u),
r AS (SELECT vec_id, avg(CASE WHEN hit THEN 1.0 WHEN hit = false THEN 0.0 END) AS a FROM w GROUP BY vec_id)"""


@query(f"WITH {_TOK} SELECT {_six('avg(a)')} AS accuracy FROM r")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda k: F.transform("s", lambda v: F.floor(v * k).cast("int"))
    return _scores(spark, d).select(M.token_accuracy(cell(5), cell(4), ignore=-1).alias("a")).agg(six(F.avg("a")).alias("accuracy"))


@query(f"SELECT {_six('avg(CASE WHEN embedding[1] > embedding[2] THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM embeddings")
def reward_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).select(F.col("s")[0].alias("c"), F.col("s")[1].alias("r"))
    return M.reward_accuracy(rows, "c", "r").select(six(F.col("accuracy")).alias("accuracy"), "n")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vqa_records").select("rec_id", F.coalesce("answer", F.lit("")).alias("p"), F.coalesce("question", F.lit("")).alias("r"))


_W = r"regexp_extract_all(lower({0}), '[一-鿿]|[^\s\p{{P}}一-鿿]+')"


def _grams(n: int) -> str:
    return f"""n{n} AS (SELECT rec_id, list_transform(range(greatest(len(p) - {n - 1}, 0)), lambda i: array_to_string(p[i + 1:i + {n}], chr(31))) AS a, list_transform(range(greatest(len(r) - {n - 1}, 0)), lambda i: array_to_string(r[i + 1:i + {n}], chr(31))) AS b FROM w),
s{n} AS (SELECT rec_id, len(a) AS la, len(b) AS lb, coalesce(list_sum(list_transform(list_intersect(a, b), lambda g: least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g))))), 0) AS m FROM n{n}),
f{n} AS (SELECT rec_id, CASE WHEN la = 0 OR lb = 0 OR m = 0 THEN 0.0 ELSE 2 * (m / la) * (m / lb) / (m / la + m / lb) END AS f FROM s{n})"""


@query(f"""WITH w AS (SELECT rec_id, {_W.format("coalesce(answer, '')")} AS p, {_W.format("coalesce(question, '')")} AS r FROM vqa_records), {_grams(1)}, {_grams(2)}
SELECT rec_id, {_six('f1.f')} AS rouge_1, {_six('f2.f')} AS rouge_2 FROM f1 JOIN f2 USING (rec_id)""")
def rouge_1_2(spark: SparkSession, d: str) -> DataFrame:
    p, r = S.word_split(F.col("p")), S.word_split(F.col("r"))
    rows = _texts(spark, d).select("rec_id", p.alias("p"), r.alias("r"))
    return rows.select("rec_id", six(S.rouge_n(F.col("p"), F.col("r"), 1)).alias("rouge_1"), six(S.rouge_n(F.col("p"), F.col("r"), 2)).alias("rouge_2"))


_ROW = "list_reduce(list_transform(range(1, len(r) + 1), lambda j: [CAST(j AS INTEGER)]), lambda acc, e: list_append(acc, CASE WHEN m[e[1]] = 1 THEN old[e[1]] + 1 ELSE greatest(acc[e[1]], old[e[1] + 1]) END), [0])"


@query(f"""WITH w AS (SELECT rec_id, {_W.format("coalesce(answer, '')")} AS p, {_W.format("coalesce(question, '')")} AS r FROM vqa_records),
l AS (SELECT rec_id, len(p) AS np, len(r) AS nr, list_reduce(list_transform(p, lambda w: list_transform(r, lambda x: CAST(x = w AS INTEGER))), lambda old, m: {_ROW}, list_transform(range(len(r) + 1), lambda k: CAST(0 AS INTEGER))) AS row FROM w),
n AS (SELECT *, CASE WHEN np = 0 OR nr = 0 THEN 0 ELSE row[nr + 1] END AS n FROM l)
SELECT rec_id, {_six("CASE WHEN n = 0 THEN 0.0 ELSE 2 * (n / np) * (n / nr) / (n / np + n / nr) END")} AS rouge_l FROM n""")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select("rec_id", S.word_split(F.col("p")).alias("p"), S.word_split(F.col("r")).alias("r"))
    return rows.select("rec_id", six(S.rouge_l("p", "r")).alias("rouge_l"))


def _letters(n: int) -> str:
    return f"""g{n} AS (SELECT rec_id, list_transform(range(greatest(length(p) - {n - 1}, 0)), lambda i: substr(p, i + 1, {n})) AS a, list_transform(range(greatest(length(r) - {n - 1}, 0)), lambda i: substr(r, i + 1, {n})) AS b FROM t),
h{n} AS (SELECT rec_id, greatest(len(a), 1) AS size, coalesce(list_sum(list_transform(list_intersect(a, b), lambda g: least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g))))), 0) AS hit FROM g{n})"""


_ZERO = lambda n: " + ".join(f"CAST(h{k}.hit = 0 AS INTEGER)" for k in range(1, n + 1))
_PART = lambda n: f"ln(CASE WHEN h{n}.hit > 0 THEN h{n}.hit / h{n}.size ELSE 1 / (power(2, {_ZERO(n)}) * h{n}.size) END) / 4"


@query(f"""WITH t AS (SELECT rec_id, coalesce(answer, '') AS p, coalesce(question, '') AS r FROM vqa_records), {", ".join(map(_letters, (1, 2, 3, 4)))}
SELECT t.rec_id, round(CASE WHEN length(p) = 0 OR length(r) = 0 OR h1.hit = 0 THEN 0.0 ELSE exp({" + ".join(map(_PART, (1, 2, 3, 4)))}) * CASE WHEN length(p) > length(r) THEN 1.0 ELSE exp(1 - length(r) / length(p)) END END * 100, 3) AS bleu
FROM t JOIN h1 USING (rec_id) JOIN h2 USING (rec_id) JOIN h3 USING (rec_id) JOIN h4 USING (rec_id)""")
def bleu4(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("rec_id", F.round(S.bleu4(F.col("p"), F.col("r")) * 100, 3).alias("bleu"))


_EV = "ev AS (SELECT user_id, event_id, event_type, value, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_EV}, w AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM ev),
r(user_id, k, v) AS (SELECT user_id, k, value * w + (1 - w) * value FROM w WHERE k = 1 UNION ALL SELECT r.user_id, w.k, r.v * w.w + (1 - w.w) * w.value FROM r JOIN w ON w.user_id = r.user_id AND w.k = r.k + 1)
SELECT user_id, k, round(v, 3) AS smooth FROM r""")
def ema_smooth(spark: SparkSession, d: str) -> DataFrame:
    return M.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("smooth", F.round("smooth", 3))


def _clip(i: int) -> str:
    last = "c0" if i == 1 else f"c{i - 1}"
    return f"c{i} AS (SELECT c.* FROM {last} c JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM {last} GROUP BY event_type) t USING (event_type) WHERE abs(c.value - t.m) <= 2 * t.s + 1e-12)"


@query(f"WITH c0 AS (SELECT event_id, event_type, value FROM events), {_clip(1)}, {_clip(2)}, {_clip(3)} SELECT event_id, event_type FROM c3")
def sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    return M.sigma_clip(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "event_type")


@query(f"WITH {_EV} SELECT user_id, event_id, round(k / n * 100, 2) AS percentage, round((s - min(s) OVER (PARTITION BY user_id)) / k * (n - k), 2) AS remaining FROM ev")
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    log = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.row_number().over(order).alias("step"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total"))
    seconds = log.withColumn("ts", F.col("us") / 1e6).withColumn("ord", F.struct("us", "event_id"))
    return quality.progress(seconds, "user_id", "ord").select("user_id", F.col("ord.event_id").alias("event_id"), "percentage", F.round("remaining", 2).alias("remaining"))


@query(f"SELECT {_six('sum(value * event_id) / sum(event_id)')} AS average FROM events")
def running_average(spark: SparkSession, d: str) -> DataFrame:
    return M.weighted_average(table(spark, d, "events"), "value", "event_id").select(six(F.col("average")).alias("average"))


@query(r"""WITH t AS (SELECT len(regexp_extract_all(coalesce(question, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS n FROM vqa_records) SELECT sum(n) * 3.0 / 100.0 / 8 AS tokens_per_second FROM t""")
def effective_tokens(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.operators.encode import token_ids

    return M.throughput(table(spark, d, "vqa_records").select(token_ids(F.col("question")).alias("ids")), ["ids"], 3.0, 100.0, 8)


@query(f"""WITH p AS (SELECT vec_id, -1 - abs(CAST(embedding[1] AS DOUBLE)) AS c, -1 - abs(CAST(embedding[2] AS DOUBLE)) AS r FROM embeddings),
o AS (SELECT *, (c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))) AS od, (c - r - 5.0) * 0.1 AS sd FROM p)
SELECT vec_id, {_six('(ln(1 + exp(-abs(od))) + greatest(-od, 0.0)) * 0.1 - c')} AS orpo, {_six('ln(1 + exp(-abs(sd))) + greatest(-sd, 0.0)')} AS simpo FROM o""")
def preference_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).select("vec_id", (-1 - F.abs(F.col("s")[0])).alias("c"), (-1 - F.abs(F.col("s")[1])).alias("r"))
    out = M.preference_losses(F.col("c"), F.col("r"))
    return rows.select("vec_id", *[six(c).alias(n) for n, c in out.items()])


@query(f"""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT query_id, vec_id, list_cosine_similarity(q.e, v.e) AS s FROM q CROSS JOIN v)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM c QUALIFY rank <= 5""")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top five for the stated query set, every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return quality.retrieve(v, q, "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")
