"""The pN queries on whole small tables: against SQL and brute force, on empty tables, nulls, repeats and clashing columns."""

import collections
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from geoquarry.llm import queries as Q
from geoquarry.llm.oracle import oracle_sql

QUERIES, SQL = Q.queries(), oracle_sql()
TABLES = ("vqa_records", "annotations", "raw_records", "dataset_registry", "documents", "eval_items", "split_targets", "mix_targets", "sample_targets")
WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


def _write(spark, data, folder, change):
    for t in TABLES:
        change(t, spark.read.parquet(f"{data}/{t}.parquet")).coalesce(2).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def _key(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return _write(spark, data, tmp_path_factory.mktemp("empty"), lambda t, df: df.where("false") if t not in ("split_targets", "mix_targets", "sample_targets", "dataset_registry") else df)


@pytest.fixture(scope="module")
def bare(spark, data, tmp_path_factory):
    """All tables without any row, targets and registry included."""
    return _write(spark, data, tmp_path_factory.mktemp("bare"), lambda t, df: df.where("false"))


@pytest.fixture(scope="module")
def dirty(spark, data, tmp_path_factory):
    """Rows of nulls, blank and very long texts, and every row of the records twice under another id."""
    keys = {"vqa_records": "rec_id", "annotations": "ann_id", "raw_records": "raw_id", "documents": "doc_id"}

    def change(t, df):
        if t not in keys:
            return df
        k = keys[t]
        texts = [c for c, kind in df.dtypes if kind == "string"]
        none = df.limit(5).select(*[(F.col(c) + 1_000_000).alias(c) if c == k else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        blank = df.limit(5).select(*[(F.col(c) + 2_000_000).alias(c) if c == k else F.lit(" \t\n ").alias(c) if c in texts else F.col(c) for c in df.columns])
        void = df.limit(5).select(*[(F.col(c) + 3_000_000).alias(c) if c == k else F.lit("").alias(c) if c in texts else F.col(c) for c in df.columns])
        long = df.limit(2).select(*[(F.col(c) + 4_000_000).alias(c) if c == k else F.repeat(F.lit("Ä long text 数 "), 20_000).alias(c) if c in texts else F.col(c) for c in df.columns])
        again = df.withColumn(k, F.col(k) + 10_000_000)
        return df.unionByName(none).unionByName(blank).unionByName(void).unionByName(long).unionByName(again)

    return _write(spark, data, tmp_path_factory.mktemp("dirty"), change)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, empty, bare, data):
    want = QUERIES[name](spark, data).dtypes
    for folder in (empty, bare):
        df = QUERIES[name](spark, folder)
        assert df.dtypes == want
        rows = df.collect()
        if not name.endswith(("_report", "_levels", "_plan")) and name not in ("p4_found", "p6_found"):
            assert rows == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_rows(name, spark, dirty):
    df = QUERIES[name](spark, dirty)
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(name, spark, data, wide):
    assert _key(QUERIES[name](spark, wide).select(*QUERIES[name](spark, data).columns).collect()) == _key(QUERIES[name](spark, data).collect())


@pytest.fixture(scope="module")
def wide(spark, data, tmp_path_factory):
    """Extra columns under names that the operators use themselves."""
    names = "source size key n m id w h k s t f place node link root band before copies category field record value words train digest first_id n_copies seen occ rec _k _s _b _h _v _o _t _f _dn _fn form ended defect ids restored".split()

    def change(t, df):
        return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})

    return _write(spark, data, tmp_path_factory.mktemp("wide"), change)


@pytest.fixture(scope="module")
def raw(duck):
    return lambda sql: duck.execute(sql).fetchall()


def test_p5_against_pairs(spark, data, raw):
    def form(x):
        if isinstance(x, str):
            return ("s", re.sub(r"[\W_]+", "", x.lower()))
        if isinstance(x, bool) or x is None:
            return x
        if isinstance(x, (int, float)):
            return ("n", float(x))
        return tuple(map(form, x)) if isinstance(x, list) else tuple(sorted((k, form(v)) for k, v in x.items()))

    first, want = {}, set()
    for i, p in raw("SELECT raw_id, payload FROM raw_records ORDER BY raw_id"):
        try:
            f = form(json.loads(p))
        except ValueError:
            continue
        if f in first:
            want.add((first[f], i))
        else:
            first[f] = i
    assert {tuple(r) for r in QUERIES["p5_found"](spark, data).collect()} == want
    kept = QUERIES["p5_collapsed"](spark, data)
    assert kept.count() == len(first) and kept.agg(F.sum("n_copies")).first()[0] == len(first) + len(want)


def test_p8_against_library(spark, data, raw):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in QUERIES["p8_ids"](spark, data).collect()}
    for d, text in raw("SELECT doc_id, text FROM documents"):
        assert got[d] == (None if text is None else t.encode(text, add_special_tokens=False).ids)


def test_p9_against_all_windows(spark, data, raw):
    windows = collections.defaultdict(set)
    for i, p in raw("SELECT item_id, passage FROM eval_items"):
        w = WORD.findall(p.lower())
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i)
    want = set()
    for d, text in raw("SELECT doc_id, text FROM documents WHERE text IS NOT NULL"):
        w = WORD.findall(text.lower())
        want |= {(d, i) for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in QUERIES["p9_found"](spark, data).collect()} == want


def test_p2_split_keeps_groups_and_shares(spark, data):
    rows = QUERIES["p2_split"](spark, data)
    assert rows.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert rows.select("rec_id").distinct().count() == rows.count()
    linked = spark.read.parquet(f"{data}/vqa_records.parquet").select("rec_id", Q.image_name(F.col("image_id")).alias("image")).join(rows, "rec_id")
    assert linked.where("image is not null").groupBy(Q.scene(F.col("image"))).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r.split: r.share for r in QUERIES["p2_report"](spark, data).collect()}
    assert abs(shares["train"] - 0.8) < 0.08 and all(s > 0 for s in shares.values())


def test_p4_mixture_keeps_limits(spark, data):
    plan = {r.source: r for r in QUERIES["p4_plan"](spark, data).collect()}
    report = QUERIES["p4_report"](spark, data).collect()
    short = {r.source for r in QUERIES["p4_found"](spark, data).collect()}
    for r in report:
        p = plan[r.source]
        assert r.most_uses <= p.max_repeats and r.used_size <= p.budget + 1e-6
        assert r.share_reached == pytest.approx(r.reachable_share, abs=0.005)
        assert (p.exponent < 1) == r.limited == (r.source in short)
        if r.limited:
            assert r.used_size == r.size * p.max_repeats
    assert sum(r.reachable_share for r in report) == pytest.approx(1)
    mixed = QUERIES["p4_mix"](spark, data)
    assert mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == sum(r.used_size for r in report)


def test_p6_sample_has_its_seats(spark, data):
    report = {(r.field, r.category): r for r in QUERIES["p6_report"](spark, data).collect()}
    drawn = {(r.field, r.category): r.n for r in QUERIES["p6_sample"](spark, data).groupBy("field", "category").agg(F.count_distinct("key").alias("n")).collect()}
    assert all(drawn.get(k, 0) == r.seats >= min(r.available, r.min_count) for k, r in report.items())
    for field in ("type", "obj_cls"):
        mine = [r for r in report.values() if r.field == field]
        assert sum(r.seats for r in mine) == min(mine[0].sample_size, sum(r.available for r in mine))


def test_found_rows_are_among_the_reports(spark, data):
    assert QUERIES["p10_found"](spark, data).count() == QUERIES["p10_restored"](spark, data).count()
    p7 = QUERIES["p7_found"](spark, data)
    assert p7.count() == p7.select("rec_id").distinct().count() == (QUERIES["p7_report"](spark, data).agg(F.sum("rows")).first()[0] or 0)
    assert {r.defect for r in p7.select("defect").distinct().collect()} <= {"empty", "truncated", "refusal", "copies_question", "other_language"}


def test_p3_report_totals_both_kinds(spark, data, raw):
    pairs = QUERIES["p3_found"](spark, data).groupBy("kind").count().collect()
    report = QUERIES["p3_report"](spark, data).collect()
    covered = QUERIES["p3_coverage"](spark, data).collect()
    want = {r["kind"]: r["count"] for r in pairs}
    assert want.keys() == {"question", "referring"}
    for kind, n in want.items():
        assert sum(r.pairs for r in report if r["kind"] == kind) == sum(r.pairs for r in covered if r["kind"] == kind) == n
    rows = {"question": raw("SELECT count(*) FROM vqa_records WHERE split IN ('val', 'test')"), "referring": raw("SELECT sum(len(objects)) FROM annotations WHERE split IN ('val', 'test')")}
    for kind, ((n,),) in rows.items():
        assert sum(r.rows for r in report if r["kind"] == kind) == n == sum(r["kind"] == kind for r in covered)
    assert all((r.pairs > 0) == (r.coverage is not None) and (r.coverage is None or 0.8 <= r.coverage <= 1) for r in covered)
