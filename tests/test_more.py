"""Kernels against plain versions, and the operators that no query runs."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoquarry.functions import misc
from geoquarry.operators import collate, evaluate, kernels, metrics, mix, prompts, regions
from geoquarry.plans import sql as sql_front
from geoquarry.sources import convert


def plain_components(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_components_are_those_of_a_flood(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random(rng.integers(1, 14, 2)) < 0.45
    assert (kernels.components(mask) == plain_components(mask)).all()


@pytest.mark.parametrize("seed", range(8))
def test_nearest_labels_are_those_of_a_full_search(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(2, 12, 2)
    label = np.where(rng.random(h * w) < 0.6, -1, rng.integers(0, 5, h * w))
    if (label >= 0).any():
        y, x = (a.ravel() for a in np.mgrid[:h, :w])
        known = np.flatnonzero(label >= 0)
        want = [label[i] if label[i] >= 0 else label[known[np.argmin((y[known] - y[i]) ** 2 + (x[known] - x[i]) ** 2)]] for i in range(h * w)]
        assert regions.nearest_labels(y, x, label).tolist() == want


def test_a_large_image_is_filled_and_labelled_in_time(spark):
    y, x = (a.ravel() for a in np.mgrid[:512, :512])
    label = np.where((x // 16 + y // 16) % 3 == 0, -1, x // 64)
    began = time.time()
    assert (regions.nearest_labels(y, x, label) >= 0).all()
    assert kernels.components((label < 0).reshape(512, 512)).max() > 1
    assert time.time() - began < 20
    pixels = spark.createDataFrame(pd.DataFrame({"image_id": 1, "y": y[:4096], "x": x[:4096], "label": label[:4096].astype("int32")}))
    assert regions.fill_unassigned(pixels).where("label < 0").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 10_000))
def test_assignment_by_component(rows, cols, seed):
    cost = np.random.default_rng(seed).random((rows, cols))
    pairs, open_rows, open_cols = kernels.assign_within(cost, 0.4)
    wide = np.full((rows, cols + rows), 0.4)
    wide[:, :cols] = np.where(cost > 0.4, 1e6, cost)
    best = sum(wide[i, j] for i, j in kernels.assign(wide)) if rows else 0.0
    assert sum(cost[i, j] for i, j in pairs) + 0.4 * len(open_rows) == pytest.approx(best)
    assert len(pairs) + len(open_rows) == rows and len(pairs) + len(open_cols) == cols


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(0, 9), st.integers(1, 6), st.integers(1, 6)), max_size=25))
def test_suppression_of_groups_is_suppression_of_each(rows):
    rows = sorted(rows, key=lambda r: r[0])
    boxes = np.array([(x, y, x + w, y + h) for _, x, y, w, h in rows], float).reshape(-1, 4)
    group = np.array([g for g, *_ in rows], int)
    kept = kernels.suppress_groups(boxes, group, 0.3)
    want = np.zeros(len(rows), bool)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        want[at[kernels.suppress(boxes[at], -np.arange(len(at), dtype=float), 0.3)]] = True
    assert (kept == want).all()


def test_suppression_limits(spark):
    rows = [(i % 2, i, float(i * 100), 0.0, float(i * 100 + 10), 10.0, 1 - i / 100, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    assert kernels.nms(df, most=3).count() == 6 and kernels.nms(df, most_in=4).count() == 8
    assert kernels.nms(df, conf=2.0).count() == 0 and kernels.nms(df, classes=[0]).where("cls <> 0").count() == 0


def test_few_shot_draws_reach_the_whole_pool(spark):
    pool = spark.range(50).select(F.lit("g").alias("g"), F.col("id").alias("item"))
    drawn = mix.support(spark.range(200).select(F.lit("g").alias("g"), F.col("id").alias("target")), pool, "g", "target", "item", 3, 5)
    assert drawn.select("item").distinct().count() > 45
    assert drawn.groupBy("target").agg(F.count_distinct("item").alias("n")).where("n <> 3").count() == 0
    two = mix.support(spark.range(9).select(F.lit("g").alias("g"), F.col("id").alias("target")), pool.where("item < 2"), "g", "target", "item", 3, 5)
    assert two.count() == 18 and mix.support(spark.range(1).select(F.lit("x").alias("g"), F.col("id").alias("target")), pool, "g", "target", "item", 3, 5).count() == 0


def test_patches_keep_a_flat_region(spark, tmp_path):
    pixels = spark.createDataFrame([(1, 0, y, x, 0.5, 0.25, 1.0) for y in range(4) for x in range(8)], "image_id bigint, label int, y int, x int, r double, g double, b double")
    rows = prompts.patches(pixels, ["r", "g", "b"], 16)
    values = np.array(rows.first()["values"]).reshape(3, 16, 16)
    assert values[:, 8].std(axis=1).max() < 1e-9 and values[0, 8, 8] == 0.5 and values[:, 0].max() == 0
    prompts.write_patches(rows, str(tmp_path), 16, 3)
    data = (tmp_path / "1" / "0.png").read_bytes()
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")


def test_cleaning_prefers_masks_that_needed_none(spark):
    solid = [(1, 0, y, x) for y in range(6) for x in range(6)]
    holed = [(1, 1, y, x) for y in range(6) for x in range(6) if (y, x) != (3, 3)]
    far = [(1, 2, y, x) for y in range(9, 12) for x in range(9, 12)] + [(1, 2, 0, 15)]
    got = prompts.cleaned(spark.createDataFrame(solid + holed + far, "image_id bigint, mask_id int, y int, x int"), 16, 16, 4)
    assert {(r.mask_id, r.changed, r.n) for r in got.groupBy("mask_id", "changed").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, False, 36), (2, True, 9)}


def test_model_is_loaded_once_a_task_and_timed(spark):
    rows = spark.range(100).coalesce(1)
    got = evaluate.score(rows, lambda: (lambda batch: batch["id"] * 2), "twice", "bigint", "seconds")
    assert got.where("twice <> id * 2 or seconds < 0").count() == 0


def test_inference_stream_calls_back(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen, hooks = [], evaluate.Callbacks()
    hooks.add("batch_start", lambda n: seen.append(("start", n)))
    hooks.add("batch_end", lambda n: seen.append(("end", n)))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    q = evaluate.inference_stream(stream, lambda: (lambda b: b["id"] + 1), "next", "bigint", lambda df, n: df.write.parquet(str(tmp_path / f"out{n}")), str(tmp_path / "state"), hooks)
    q.awaitTermination()
    assert seen == [("start", 0), ("end", 0)] and spark.read.parquet(str(tmp_path / "out0")).agg(F.sum("next")).first()[0] == 55


def test_accumulator_and_merging(spark, tmp_path):
    a = evaluate.Accumulator(["x"])
    for part in ([1.0, 3.0], [None, 5.0], []):
        a.update(spark.createDataFrame([(v,) for v in part], "x double"))
    assert a.dump() == {"x": 3.0} and a.dump() == {"x": None}
    (tmp_path / "predictions_rank0.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "predictions_rank2.json").write_text(json.dumps([{"id": 3}]))
    rows, missing = evaluate.merge_ranks(spark, str(tmp_path), 3, "id bigint")
    assert rows.count() == 3 and missing == [1]
    assert evaluate.merge_ranks(spark, str(tmp_path / "none"), 2, "id bigint")[0].count() == 0


def test_eval_templates():
    evaluate.register_eval_template("own", evaluate.EvalTemplate("About {subject}: ", " ({choice}) {content}", " ->"))
    for f in (lambda: evaluate.eval_template("none"), lambda: evaluate.register_eval_template("own", evaluate.EvalTemplate("", "", ""))):
        with pytest.raises(ValueError):
            f()


def test_results_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x")], "subject string, row int, output string")
    lines = evaluate.score_lines(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "c string, ok boolean"), "c", "ok")
    evaluate.write_results(rows, lines, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r" / "scores")).collect()) == sorted([f"{'a':>15}: 50.00", f"{'b':>15}: 100.00", f"{'Average':>15}: 66.67"])
    with pytest.raises(Exception, match="(?i)exist"):
        evaluate.write_results(rows, lines, str(tmp_path / "r"))


@pytest.mark.parametrize(("source", "kind"), [("0", "stream"), ("rtsp://x/y", "stream"), ("http://x/a.jpg", "image"), ("a/b.MP4", "video"), ("screen 0", "screenshot"), ("folder", "folder"), (["a"], "list"), (np.zeros((2, 2, 3)), "memory"), ("cams.streams", "stream")])
def test_source_kinds(source, kind):
    assert convert.source_kind(source) == kind


def test_media(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"12")
    (tmp_path / "b.mp4").write_bytes(b"abcdef")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = convert.media_files(spark, str(tmp_path), 2, lambda data: [bytes([b]) for b in data])
    assert sorted((r.kind, r.frame, bytes(r.data)) for r in got.collect()) == [("image", 0, b"12"), ("video", 0, b"a"), ("video", 2, b"c"), ("video", 4, b"e")]
    assert convert.media_files(spark, str(tmp_path)).count() == 2
    images = convert.decoded(convert.media_files(spark, str(tmp_path)), "data", lambda d: (len(d), 1, d) if d == b"12" else 1 / 0)
    assert {r.kind: r.image and r.image.width for r in images.collect()} == {"image": 2, "video": None}
    arrays = convert.from_memory(spark, [np.zeros((2, 3, 3), np.uint8), np.ones((1, 1), np.uint8)])
    assert [(r.height, r.width, r.channels, len(r.data)) for r in arrays.orderBy("frame_id").collect()] == [(2, 3, 3, 18), (1, 1, 1, 1)]
    assert convert.crop_boxes(bytes(range(12)), 3, 4, 1, [(1, 1, 3, 3)]) == [bytes([5, 6, 9, 10])]
    line = spark.range(1).select(convert.polygon_line(F.lit(2), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 5), (20, 8))]), F.lit(40.0), F.lit(10.0)).alias("l")).first().l
    assert line == "2 0.25 0.5 0.5 0.8"


def test_existing_paths_only(spark):
    lines = spark.createDataFrame([('{"images": ["a.png", "", "/b.png"]}',), ("{oops",), ("",), ('{"images": null}',), ('{"images": "a.png"}',)], "value string")
    paths, broken = convert.image_paths(lines, "images", "/d/", spark.createDataFrame([("/d/a.png",), ("/z.png",)], "path string"))
    assert [r.path for r in paths.collect()] == ["/d/a.png"] and lines.where(broken).count() == 1


def test_modalities(spark):
    with pytest.raises(ValueError, match="video"):
        collate.check_modalities(spark.range(1).withColumn("v", F.array()), {"video": "v"}, {"image"})
    collate.check_modalities(spark.range(1), {"video": "v"}, {"image"})


def test_small_functions(spark):
    row = spark.range(1).select(misc.elapsed(F.lit(90061.9)).alias("a"), misc.elapsed(F.lit(0)).alias("b"), misc.elapsed(F.lit(3 * 86400)).alias("c"), misc.media_uri(F.lit("data:audio/wav;base64,!!"))[1].alias("d"), misc.media_uri(F.lit(None).cast("string"))[0].alias("e")).first()
    assert tuple(row) == ("1 day, 1:01:01", "0:00:00", "3 days, 0:00:00", None, None)


def test_functions_in_sql_text(spark, data):
    names = sql_front.register(spark, data)
    assert "documents" in names
    row = spark.sql("""SELECT image_name('a/B_1.PNG') i, scene_of('b_1') s, box_iou(0, 0, 2, 2, 1, 1, 3, 3) o, tool_offer('mistral', '[{"name": "f"}]') t, tool_calls('qwen', '<tool_call>{"name": "f", "arguments": {}}</tool_call>') c, tool_offer('none', '[]') n""").first()
    assert (row.i, row.s) == ("b_1", "b") and row.o == pytest.approx(1 / 7) and '"name": "f"' in row.t and json.loads(row.c) == [{"name": "f", "arguments": "{}"}] and row.n is None


def test_class_maps_fill_with_the_mean(spark):
    ap = spark.createDataFrame([(0.5, 0, 0.4), (0.55, 0, 0.2), (0.5, 2, 0.9)], "threshold double, cls int, ap double")
    assert {r.cls: round(r.map, 6) for r in metrics.class_maps(ap, 4).collect()} == {0: 0.3, 1: 0.6, 2: 0.9, 3: 0.6}
    best = spark.createDataFrame([(0, 0.5, 0.25), (2, 1.0, 0.75)], "cls int, precision double, recall double")
    row = metrics.mean_results(best, ap).first()
    assert (row.mp, row.mr) == (0.75, 0.5)
