"""Worked examples and properties of the operators."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoquarry.functions import geometry as G
from geoquarry.functions import templates as T
from geoquarry.functions import textscore as S
from geoquarry.functions import tools as X
from geoquarry.operators import align, encode, kernels, metrics, mix, quality, regions, tokens
from geoquarry.operators.ranking import rank_in_hash_order, running_in_hash_order
from geoquarry.sources import files, registry, sinks
from geoquarry.streaming import tracking

MASKS = [(1, [1, 1, 2, 2, 2, 0]), (2, [1, 2, 2, 3, 3, 3])]


def test_packed_masks(spark):
    df = spark.createDataFrame(MASKS, "id int, m array<int>")
    rows = df.select("id", encode.sequence_lengths(F.col("m")).alias("n"), encode.unpadded(F.col("m")).alias("u")).orderBy("id").collect()
    assert [x for r in rows for x in r.n] == [2, 3, 1, 2, 3]
    assert [i + 6 * k for k, r in enumerate(rows) for i in r.u] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    n = df.select(encode.offsets(F.array(*map(F.lit, (2, 3, 1, 2, 3)))).alias("o")).first().o
    assert n == [0, 2, 5, 6, 8, 11]
    pairs = encode.block_causal(df.where("id = 1"), "id", "m").select("i", "j").collect()
    assert sorted(map(tuple, pairs)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2), (3, 3), (4, 2), (4, 3), (4, 4)]
    assert df.select(encode.packed_positions(F.array(F.lit(2), F.lit(3))).alias("p")).first().p == [0, 1, 0, 1, 2]


def test_vision_then_text_positions(spark):
    seg = lambda **k: F.struct(*[F.lit(k.get(n, "text" if n == "kind" else 0)).alias(n) for n in ("kind", "n", "t", "h", "w", "step")])
    p = spark.range(1).select(tokens.vision_positions(F.array(seg(kind="vision", t=3, h=2, w=2, step=50), seg(n=5))).alias("p")).first().p
    assert [x.t for x in p] == [0] * 4 + [50] * 4 + [100] * 4 + [101, 102, 103, 104, 105]
    assert [(x.h, x.w) for x in p[:4]] == [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize(("s", "t", "cutoff", "want"), [(100, 10, 50, (40, 10)), (10, 100, 50, (10, 40)), (100, 100, 50, (25, 25)), (3, 4, 50, (3, 4)), (0, 0, 0, (0, 0))])
def test_budget(spark, s, t, cutoff, want):
    a, b = encode.budget(F.lit(s), F.lit(t), cutoff)
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b or 0) == want


def test_annotation_file_flattens(spark, tmp_path):
    note = {"caption": "c", "image": "i.png", "objects": [{"obj_id": 0}, {"obj_id": 1}], "qa_pairs": [{"ques_id": k} for k in range(4)]}
    (tmp_path / "a.json").write_text(json.dumps(note, indent=1))
    df = files.scan(spark, str(tmp_path / "a.json"))
    assert df.select(F.explode("objects")).count() == 2 and df.select(F.explode("qa_pairs")).count() == 4


def test_registry(tmp_path, spark):
    entries = {"a": {"file_name": "a.jsonl", "formatting": "sharegpt", "columns": {"messages": "turns"}}, "b": {"file_name": "x", "hf_hub_url": "h/b", "ranking": True}}
    (tmp_path / "dataset_info.json").write_text(json.dumps(entries))
    r = registry.load_registry(tmp_path)
    assert r["a"].columns == {"messages": "turns"} and r["b"].kind == "hub" and r["b"].columns["prompt"] == "instruction"
    assert [s.name for s in registry.resolve(r, "b, a")] == ["b", "a"]
    for bad in (lambda: registry.resolve(r, ["c"]), lambda: registry.check_stage(r["a"], "rm"), lambda: files.load(spark, r["b"], "."), lambda: registry.mapped(spark.range(1), r["a"])):
        with pytest.raises(registry.RegistryError):
            bad()
    assert registry.catalog(spark, r, "rm").count() == 1


def test_scan_formats(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "a.csv").write_text('x,y\n1,"q\nr"\n')
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    t = pa.table({"x": [1, 2]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert {e: files.scan(spark, str(tmp_path / f"a.{e}")).count() for e in ("csv", "json", "jsonl", "txt", "arrow")} == {"csv": 1, "json": 2, "jsonl": 3, "txt": 2, "arrow": 2}
    with pytest.raises(registry.RegistryError, match="identical"):
        files.scan(spark, str(tmp_path))
    with pytest.raises(registry.RegistryError):
        files.scan(spark, str(tmp_path / "none"))


def test_cache_insert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, v int")
    files.insert_missing(rows, path)
    files.insert_missing(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), path)
    assert spark.read.parquet(path).count() == 3


def test_openai_merges_tool_results(spark):
    turns = [("system", "s", None), ("user", "q", None), ("assistant", "", '[{"name": "f", "arguments": {}}]'), ("tool", "1", None), ("tool", "2", None), ("assistant", "a", None)]
    df = spark.createDataFrame([(turns,)], "m array<struct<role:string,content:string,tool_calls:string>>")
    p, r, s = align.openai(F.col("m"))
    row = df.select(p.alias("p"), r.alias("r"), s.alias("s")).first()
    assert [m.role for m in row.p] == ["user", "function", "observation"] and row.p[2].content == "1" + align.TOOL_JOINT + "2"
    assert row.r[0].content == "a" and row.s == "s\n\ndetailed thinking off"


def test_sharegpt_ranking_and_feedback(spark):
    turn = "struct<from:string,value:string>"
    df = spark.createDataFrame([([("human", "q")], ("gpt", "good"), ("gpt", "bad"), True), ([("human", "q"), ("gpt", "a")], ("human", "x"), ("gpt", "y"), False)], f"m array<{turn}>, c {turn}, r {turn}, k boolean")
    p, r, _ = align.sharegpt(F.col("m"), ranking=True, chosen=F.col("c"), rejected=F.col("r"))
    rows = df.select(F.size(p).alias("p"), F.size(r).alias("r")).collect()
    assert [(x.p, x.r) for x in rows] == [(1, 2), (0, 0)]
    p, r, _ = align.sharegpt(F.col("m"), kto=F.col("k"))
    assert [[m.content for m in x.r] for x in df.select(r.alias("r")).collect()] == [[], ["", "a"]]


def test_alpaca_history(spark):
    df = spark.createDataFrame([("p", "", "a", [["x", "y"]])], "p string, q string, a string, h array<array<string>>")
    p, r = align.alpaca(F.col("p"), F.col("q"), F.col("a"), F.col("h"))
    row = df.select(p.alias("p"), r.alias("r")).first()
    assert [(m.role, m.content) for m in row.p] == [("user", "x"), ("assistant", "y"), ("user", "p")] and row.r[0].content == "a"
    with pytest.raises(ValueError):
        align.register_converter("alpaca", align.alpaca)


def test_urls_and_paths(spark):
    df = spark.createDataFrame([("http://example.org/a", True), ("https://127.0.0.1/x", False), ("ftp://example.org", False), ("http://10.0.0.8/", False), (None, False)], "u string, ok boolean")
    assert df.where(align.safe_url(F.col("u")) != F.col("ok")).count() == 0
    p = spark.createDataFrame([("/m/a.png", True), ("/m/../etc", False), ("/x/a", False)], "p string, ok boolean")
    assert p.where(align.safe_path(F.col("p"), "/m") != F.col("ok")).count() == 0


@pytest.mark.parametrize("name", [d for d in X.DIALECTS if d not in ("glm4_moe",)])
def test_dialects_read_what_they_write(name):
    calls = [("find_it", {"n": 1, "s": "é"})]
    text = X.written(name, json.dumps([{"name": n, "arguments": a} for n, a in calls], ensure_ascii=False))
    assert [(n, json.loads(a)) for n, a in X.dialect(name).read(text)] == calls
    assert X.dialect(name).read("no call here") in ("no call here", [])
    assert X.offered(name, "[]") == "" and "find_it" in X.offered(name, json.dumps([{"name": "find_it", "description": "d", "parameters": {"properties": {}}}]), "today")


def test_bad_calls_stay_text():
    assert X.dialect("default").read("Action: a\nAction Input: {oops") == "Action: a\nAction Input: {oops"
    assert X.written("qwen", '<think>x</think>\n{"name": "a", "arguments": {}}').startswith("<think>x</think>\n<tool_call>")
    with pytest.raises(ValueError):
        X.written("qwen", "no json")


def test_templates(spark):
    df = spark.createDataFrame([([("user", "q"), ("assistant", "<think>\nt\n</think>\n\na"), ("user", "r"), ("assistant", "<think>\nu\n</think>\n\nb")],)], "m array<struct<role:string,content:string>>")
    out = df.select(T.render(T.resolve("qwen3"), F.col("m")).alias("t")).first().t
    assert "t\n" not in out[1] and out[1].startswith("a") and "u" in out[3]
    assert df.select(T.render(T.resolve("llama2"), F.col("m"), F.lit("S")).alias("t")).first().t[0] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nq [/INST]"
    assert "{{content}}" in T.inferred(lambda ms: "".join(f"<{m['role']}>{m['content']}</>" for m in ms), "probe").user
    assert T.jinja(T.resolve("chatml")).count("message['content']") == 4
    for bad in (lambda: T.resolve("nope"), lambda: T.register(T.Template("x", user="none")), lambda: T.resolve("qwen", tool_format="nope")):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(20, 50))
def test_knapsacks_hold_each_row_once(lengths, capacity):
    packs = kernels.knapsacks(lengths, capacity)
    assert sorted(i for p in packs for i in p) == [i for i, n in enumerate(lengths) if n <= capacity]
    assert all(sum(lengths[i] for i in p) <= capacity for p in packs)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, rnd):
    from itertools import permutations

    cost = np.array([[rnd.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
    pairs = kernels.assign(cost)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    c = cost if n <= m else cost.T
    best = min(sum(c[i, p[i]] for i in range(c.shape[0])) for p in permutations(range(c.shape[1]), c.shape[0]))
    assert sum(cost[i, j] for i, j in pairs) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=5, max_size=5), min_size=1, max_size=6))
def test_run_lengths_round_trip(rows):
    mask = np.array(rows, bool)
    runs = kernels.run_lengths(mask)
    assert sum(runs) == mask.size and sum(runs[1::2]) == mask.sum()
    assert (kernels.from_runs(runs, *mask.shape) == mask).all()


def test_suppression_leaves_no_overlap():
    rng = np.random.default_rng(0)
    b = rng.uniform(0, 50, (80, 2))
    boxes = np.concatenate([b, b + rng.uniform(5, 30, (80, 2))], 1)
    kept = kernels.suppress(boxes, rng.uniform(size=80), 0.4)
    iou = kernels.box_iou(boxes[kept], boxes[kept], 0.0) - np.eye(len(kept))
    assert kept and iou.max() <= 0.4


def test_masks_and_polygons():
    m = kernels.polygon_mask(np.array([[1, 1], [5, 1], [5, 4], [1, 4]], float), 6, 7)
    assert m.sum() == 12 and m[1:4, 1:5].all()
    assert set(map(tuple, kernels.outline(m))) == {(1, 1), (5, 1), (5, 4), (1, 4)}
    holes, changed = kernels.without_small(np.pad(np.ones((3, 3), bool), 1) & ~np.pad(np.ones((1, 1), bool), 2), 2, "holes")
    assert changed and holes.sum() == 9
    islands = np.zeros((5, 5), bool)
    islands[0, 0] = islands[2:4, 2:4] = True
    assert kernels.without_small(islands, 3, "islands")[0].sum() == 4
    assert kernels.without_small(islands, 9, "islands")[0].sum() == 4
    assert len(kernels.resample(np.array([[0, 0], [1, 0], [1, 1]], float), 10)) == 10
    assert len(kernels.joined_segments([np.zeros((3, 2)), np.ones((3, 2))])) == 8
    assert kernels.assemble_masks(np.ones((2, 4, 4)), np.array([[1.0, 1.0], [-1.0, -1.0]]), np.array([[0, 0, 2, 2], [0, 0, 4, 4]], float)).sum() == 4


def test_box_round_trips(spark):
    df = spark.createDataFrame([(3.0, 4.0, 13.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    b = G.box()
    for there, back in ((G.xyxy_to_xywh, G.xywh_to_xyxy), (G.xyxy_to_ltwh, G.ltwh_to_xyxy), (lambda v: G.ltwh_to_xywh(G.xyxy_to_ltwh(v)), lambda v: G.ltwh_to_xyxy(G.xywh_to_ltwh(v))), (lambda v: G.xyxy_to_xywhn(v, 32, 16), lambda v: G.xywhn_to_xyxy(v, 32, 16))):
        assert [float(x) for x in df.select(*[c.alias(f"c{i}") for i, c in enumerate(back(there(b)))]).first()] == [3.0, 4.0, 13.0, 10.0]


def test_scalars(spark):
    row = spark.range(1).select(G.quantize(F.lit(0.5)).alias("q"), G.divisible(F.lit(33), 32).alias("d"), G.frame_indices(F.lit(10.0), F.lit(100), 0.5, 8).alias("f"), G.longest_side(F.lit(100), F.lit(50), 64)[1].alias("l"), quality.to_80(F.lit(13)).alias("c"), sinks.pads_last(F.array(*map(F.lit, (0, 0, 5, 6))), 0).alias("p"), G.aspect_clamp(F.lit(10), F.lit(10000))[1].alias("a")).first()
    assert (row.q, row.d, row.f, row.l, row.c, row.p, row.a) == (2048, 64, [0, 24, 49, 74, 99], 32, 11, [5, 6, 0, 0], 5760)


def test_scores(spark):
    df = spark.createDataFrame([("the cat sat", "the cat"), ("", "x"), ("ab", "ab"), (None, None)], "p string, r string")
    rows = df.select(S.rouge_n(S.word_split(F.col("p")), S.word_split(F.col("r")), 1).alias("r1"), S.rouge_l(S.word_split(F.col("p")), S.word_split(F.col("r"))).alias("rl"), S.bleu4("p", "r").alias("b")).collect()
    assert [round(r.r1, 6) for r in rows] == [0.8, 0.0, 1.0, 0.0] and [round(r.rl, 6) for r in rows] == [0.8, 0.0, 1.0, 0.0]
    assert rows[1].b == rows[3].b == 0.0 and 0 < rows[2].b <= 1


def test_average_precision_as_by_hand(spark):
    rng = np.random.default_rng(1)
    hits = rng.integers(0, 2, 40)
    n_true = 30
    rows = [(0.5, 0, float(np.cumsum(hits)[i] / n_true), float(np.cumsum(hits)[i] / (i + 1))) for i in range(40)]
    got = metrics.average_precision(spark.createDataFrame(rows, "threshold double, cls int, recall double, precision double")).first().ap
    r, p = np.array([0.0, *[x[2] for x in rows], 1.0]), np.array([1.0, *[x[3] for x in rows], 0.0])
    p = np.flip(np.maximum.accumulate(np.flip(p)))
    x = np.linspace(0, 1, 101)
    assert math.isclose(got, np.trapezoid(np.interp(x, r, p), x), abs_tol=1e-9)


def test_smoothing(spark):
    df = spark.createDataFrame([(0, i, float(i % 5)) for i in range(20)], "g int, i int, v double")
    got = [r.smooth for r in metrics.smoothed(df, ["g"], "i", "v", 0.1).orderBy("i").collect()]
    v = np.array([i % 5 for i in range(20)], float)
    pad = np.concatenate([np.full(2, v[0]), v, np.full(2, v[-1])])
    assert np.allclose(got, np.convolve(pad, np.ones(5) / 5, "valid"))


def test_hash_order(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    ranks = rank_in_hash_order(df, ["g"], ["id"], 1, "r").groupBy("g").agg(F.count_distinct("r").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
    assert all((r.n, r.a, r.b) == (1000, 1, 1000) for r in ranks)
    last = running_in_hash_order(df, ["g"], ["id"], F.col("v"), 1, "s").groupBy("g").agg(F.max(F.col("s") + F.col("v")).alias("t"), F.sum("v").alias("u")).collect()
    assert all(r.t == r.u for r in last)


def test_sampling_and_splits(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    assert mix.sample_exact(df, "k", 120, 3).distinct().count() == 120
    more = mix.sample_exact(df, "k", 800, 3)
    assert more.count() == 800 and more.where("copy = 0").count() == 500
    assert {r.split: r.n for r in mix.split_exact(df, "k", 50, 1).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"validation": 50, "train": 450}
    assert set(mix.modules(mix.split(df, "k", 0.2, 1))) == {"train", "validation"}
    assert sorted(r.row_no for r in mix.numbered(df, "k").select("row_no").collect()) == list(range(500))
    assert mix.sample_exact(df.where("false"), "k", 10, 1).count() == 0
    with pytest.raises(ValueError):
        mix.interleave([df], "k", "sideways")


def test_argument_checks():
    assert encode.check_arguments(stage="sft", cutoff=10, neat_packing=True) == {"packing": True, "cutoff": 9}
    for bad in ({"val_size": 0.1, "eval_dataset": ["a"]}, {"streaming": True, "val_size": 0.1}, {"streaming": True, "max_samples": 1}, {"mask_history": True, "train_on_prompt": True}, {"weights": [1.0]}, {"weights": [1.0], "mix_strategy": "interleave", "datasets": ["a", "b"]}):
        with pytest.raises(ValueError):
            encode.check_arguments(stage="sft", cutoff=10, **bad)
    assert encode.processor("sft", packing=True) == "packed_sft" and encode.processor("sft", generate=True) == "unsupervised"
    assert quality.check_dataset({"train": "a", "val": "b", "names": ["x", "y"]})["nc"] == 2
    with pytest.raises(ValueError):
        quality.check_dataset({"train": "a"})


def test_packing_keeps_rows(spark):
    rows = spark.createDataFrame([(0, i, [i] * n, [i] * n) for i, n in enumerate([5, 3, 9, 2, 20, 7, 1])], "b int, k int, input_ids array<int>, labels array<int>")
    packs = encode.pack(rows, "b", "k", 10).collect()
    assert sorted(k for p in packs for k in p["keys"]) == [0, 1, 2, 3, 5, 6]
    assert all(len(p.input_ids) == len(p.labels) == len(p.attention_mask) == 11 for p in packs)


def test_diffusion_tables_and_arrays_agree(spark, data):
    from geoquarry.plans.q_regions import _graph

    _, nodes, k = _graph(spark, data)
    a = {(r.image_id, r.region): r.temp for r in regions.diffuse(nodes, k, 0.1, 3).collect()}
    b = {(r.image_id, r.region): r.temp for r in regions.diffuse_tables(nodes, k, 0.1, 3).collect()}
    assert a.keys() == b.keys() and max(abs(a[x] - b[x]) for x in a) < 1e-9


def test_max_size_split_respects_limit(spark):
    px = spark.createDataFrame([(0, y, x, 0) for y in range(8) for x in range(8)], "image_id bigint, y int, x int, label int")
    out = regions.split_large(px, 24, 8).groupBy("label").count().collect()
    assert len(out) == 8 and sum(r["count"] for r in out) == 64


def test_background_components():
    m = -np.ones((9, 9), int)
    m[:, 4] = 0
    assert regions.background_regions(m, 3).max() == 2


def test_tracker_follows_and_forgets():
    o = tracking.Options(buffer=2)
    t = tracking.Tracker(o, tracking.State())
    box = lambda x: np.array([[x, 10.0, x + 20, 40.0]])
    ids = [t.update(box(10.0 + 2 * i), np.array([0.9]), np.array([0]))[0].track_id for i in range(4)]
    assert ids == [1] * 4
    for i in range(4):
        t.update(box(300.0), np.array([0.9]), np.array([0]))
    t = tracking.Tracker(o, tracking.State.load(t.s.dump()))
    out = t.update(np.concatenate([box(18.0), box(300.0)]), np.array([0.9, 0.9]), np.array([0, 0]))
    assert 1 not in {x.track_id for x in out} and 2 in {x.track_id for x in out}


@pytest.mark.parametrize("mode", ["height", "both"])
def test_kalman(mode):
    k = tracking.Kalman(mode)
    mean, cov = k.start(tracking.measure(np.array([0, 0, 10, 20.0]), mode))
    for i in range(1, 30):
        mean, cov = k.predict(mean, cov)
        mean, cov = k.update(mean, cov, tracking.measure(np.array([i, 0, 10 + i, 20.0]), mode))
    assert abs(mean[4] - 1) < 0.1 and np.allclose(cov, cov.T, atol=1e-9)
    assert np.allclose(tracking.corners(mean, mode), [29, 0, 39, 20], atol=0.5)
    assert k.gate(mean, cov, mean[None, :4])[0] < 1e-9
    t = tracking.Track(1, 1, True, 0, 0, 1.0, 0, mean, cov)
    tracking.warped(t, np.array([[1, 0, 5.0], [0, 1, 0.0]]))
    assert abs(t.mean[0] - mean[0] - 5) < 1e-9


def test_media_resolution(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, images array<string>")
    out = {r.k: r.images for r in files.resolve_media(rows, "k", "images", spark.createDataFrame([("/m/b",)], "path string"), "/m").collect()}
    assert out == {1: ["a", "/m/b"], 2: None, 3: None}


def test_progress_and_counters(spark):
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id int")
    labels = spark.createDataFrame([(0, 2), (1, 0)], "image_id int, n int")
    row = quality.image_counters(images, labels, labels.where("n = 2")).first()
    assert (row.missing, row.found, row.empty, row.corrupt) == (2, 2, 1, 1)


def test_sets_of_tracks(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "track_id int") for x in ([1, 2], [2, 3]))
    assert [r[0] for r in tracking.sub(a, b).collect()] == [1]
    assert sorted(r[0] for r in tracking.joint(a, b).collect()) == [1, 2, 3]
    assert tracking.removed_kept(a, "track_id", 1).first()[0] == 2
