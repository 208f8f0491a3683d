"""The training-data operators on small cases of their own."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoquarry.functions.text import image_name, normal_form, question_number, scene, words
from geoquarry.llm import crosssplit, encoding, formatting, frequency, garbled, leakage, mixing, pairs, sampling, splits


def test_text_functions(spark):
    df = spark.createDataFrame([("a/B_1.PNG", "Q-0007.0", "Ünï-x  2"), ("", "none", "  !"), (None, None, None), ("x\\e7", " 12.0 ", "你好 W")], "p string, q string, t string")
    rows = df.select(image_name(F.col("p")).alias("i"), scene(image_name(F.col("p"))).alias("s"), question_number(F.col("q")).alias("n"), normal_form(F.col("t")).alias("f"), words(F.col("t")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [("b_1", "b", "7", "ünï x 2", ["ünï", "x", "2"]), (None, None, None, "", []), (None, None, None, "", []), ("e7", "e7", "12", "你好 w", ["你好", "w"])]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from("a b c".split()), max_size=5)), max_size=30))
def test_suffix_intervals_count_all_ngrams(spark, rows):
    df = spark.createDataFrame([("f", str(r), " ".join(w)) for r, w in rows], "field string, record string, value string")
    got = {(r.ngram, r.n): (r.occurrences, r.records) for r in frequency.ngram_frequencies(df, longest=10).collect()}
    want = {}
    for record, w in rows:
        if not w:
            continue
        seq = [frequency.BEGIN, *w, frequency.END]
        for i in range(len(seq) - 1):
            for j in range(i + 1, len(seq) + 1):
                g = want.setdefault((frequency.SEP.join(seq[i:j]), j - i), [0, set()])
                g[0] += 1
                g[1].add(record)
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_no_ngram_is_too_long_to_be_counted(spark):
    """Forty common words in the middle of three values of two records, and a word that repeats: every n-gram has its numbers."""
    middle = [f"m{i}" for i in range(40)]
    rows = [("a", ["x", *middle, "y"]), ("a", [*middle, "z"]), ("b", ["x", "x", *middle]), ("b", ["r"] * 20), (None, ["r"] * 9)]
    df = spark.createDataFrame([("f", r, " ".join(w)) for r, w in rows], "field string, record string, value string")
    want = {}
    for record, w in rows:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                g = want.setdefault(tuple(w[i:j]), [0, set()])
                g[0] += 1
                g[1].add(record)
    texts = {hashlib.md5(" ".join(w).encode()).hexdigest(): w for _, w in rows}
    got = {}
    for r in frequency.word_runs(df).collect():
        for n in range(r.shortest, r.longest + 1):
            gram = tuple(texts[r.value][r.start - 1 : r.start - 1 + n])
            assert len(gram) == n and gram not in got
            got[gram] = (r.occurrences, r.records)
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert got[tuple(middle)] == (3, 2) and got[("r",) * 20] == (1, 1)


def test_values_come_from_the_whole_suffix_array(spark, monkeypatch):
    """Marks are read off the intervals over all suffixes, those inside the values included."""
    seen = []
    walk = frequency.suffix_ranks
    monkeypatch.setattr(frequency, "suffix_ranks", lambda texts: seen.append(walk(texts)) or seen[-1])
    df = spark.createDataFrame([("f", str(i), v) for i, v in enumerate(["a b c"] * 3 + ["b c"])], "field string, record string, value string")
    got = {(r.term, r.occurrences, r.records, r.mark) for r in frequency.value_frequencies(df).collect()}
    assert got == {("a b c", 3, 3, "common"), ("b c", 1, 1, "rare")}
    assert seen[0][0].where("left > 1").count() == 7


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_forest_spans_components(spark, links):
    df = spark.createDataFrame([(f"n{a}", f"l{b}") for a, b in links] + [(None, "x"), ("n0", None)], "node string, link string")
    edges = splits.link_edges(df)
    forest, roots = splits.spanning_forest(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(f"n{a}")] = root(f"l{b}")
    got = {r.node: r.root for r in roots.collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    want = {}
    for n in got:
        want.setdefault(root(n), set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert forest.count() == len(got) - len(groups)


def test_deal_follows_shares(spark):
    groups = spark.createDataFrame([(f"g{i}", 1 + (i % 7 == 0) * 5 + (i == 3) * 900) for i in range(3000)], "root string, size bigint")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    out = splits.deal_groups(groups, targets)
    total = groups.agg(F.sum("size")).first()[0]
    share = {r.split: r.n / total for r in out.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert share.keys() == {"train", "val", "test"} and all(abs(share[s] - w) < 0.01 for s, w in (("train", 0.8), ("val", 0.1), ("test", 0.1)))
    assert out.count() == 3000
    assert splits.deal_groups(groups, targets.where("false")).where("split is not null").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.lists(st.sampled_from("a b c d e f g h i j k l".split()), min_size=1, max_size=12)), max_size=40))
def test_fingerprints_lose_no_pair(spark, rows):
    df = spark.createDataFrame([("question", f"p{p}", i, t, list(dict.fromkeys(w))) for i, (p, t, w) in enumerate(rows)], "kind string, place string, key bigint, train boolean, words array<string>")
    got = {(r.train_key, r.eval_key) for r in crosssplit.near_pairs(df).collect()}
    want = set()
    for i, (p, t, w) in enumerate(rows):
        for j, (q, u, x) in enumerate(rows):
            if p == q and t and not u and 5 * len(set(w) & set(x)) >= 4 * len(set(w) | set(x)):
                want.add((i, j))
    assert got == want


def test_hot_place_is_not_paired_out(spark):
    """Many rows of one place that share their frequent words give few candidates."""
    rows = [("question", "p", i, i % 10 != 0, f"in sector of the big plant how many ships x{i} y{i} z{i}".split()) for i in range(2000)]
    df = spark.createDataFrame(rows, "kind string, place string, key bigint, train boolean, words array<string>")
    assert crosssplit.near_pairs(df).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.floats(0.0, 1.0), st.integers(0, 6)), min_size=1, max_size=7))
def test_mixture_plan_fills_what_limits_leave(rows):
    whole = max(1.0, sum(t for _, t, _ in rows))
    rows = [(n, t / whole, m) for n, t, m in rows]
    targets = [(str(i), t, m) for i, (_, t, m) in enumerate(rows)]
    plan = mixing.plan_mixture({str(i): (n, n) for i, (n, _, _) in enumerate(rows)}, targets)
    total = sum(n for n, _, _ in rows)
    for p, (n, t, m) in zip(plan, rows):
        assert p["limited"] == (n * m < t * total)
        assert p["budget"] <= n * m + 1e-6
    room = sum(n * m for n, t, m in rows if t > 0 or n * m < t * total)
    if any(t > 1e-6 for _, t, _ in rows):
        assert sum(p["budget"] for p in plan) == pytest.approx(min(total, room), rel=1e-4, abs=1e-3) or any(0 < t <= 1e-6 for _, t, _ in rows)


def test_mixture_plan():
    plan = {p["source"]: p for p in mixing.plan_mixture({"a": (10, 900), "b": (5, 100)}, [("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.1, 2)])}
    assert not plan["a"]["limited"] and plan["a"]["budget"] == pytest.approx(700) and plan["b"]["limited"] and plan["b"]["budget"] == 300 and plan["c"]["limited"] and plan["c"]["budget"] == 0
    assert plan["b"]["exponent"] == pytest.approx(math.log(3) / math.log(5), rel=1e-9) and plan["a"]["exponent"] == 1.0
    free = mixing.plan_mixture({"a": (1, 900), "b": (1, 100)}, [("a", None, None), ("b", None, 20)])
    assert sum(p["target_share"] for p in free) == pytest.approx(1)
    shares = [0.9, 0.1]
    a = mixing.entropy_exponent(shares, 0.8)
    w = [s**a for s in shares]
    assert -sum(x / sum(w) * math.log2(x / sum(w)) for x in w) == pytest.approx(0.8, abs=1e-6)


def test_limited_sources_come_from_the_exponent(monkeypatch):
    sizes, targets = {"a": (10, 900), "b": (5, 100)}, [("a", 0.5, 1), ("b", 0.5, 3)]
    assert [p["limited"] for p in mixing.plan_mixture(sizes, targets)] == [False, True]
    monkeypatch.setattr(mixing, "common_exponent", lambda sources: (1.0, []))
    assert not any(p["limited"] for p in mixing.plan_mixture(sizes, targets))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(0.01, 1.0), st.integers(0, 8)), min_size=1, max_size=6), st.integers(0, 120))
def test_seats_are_the_smallest_priorities(rows, size):
    available = {str(i): n for i, (n, _, _) in enumerate(rows)}
    got = sampling.seats(available, [(str(i), t, m) for i, (_, t, m) in enumerate(rows)], size)
    assert sum(got.values()) == min(size, sum(available.values()))
    assert all(got[c] <= available[c] for c in got)
    floors = {str(i): min(n, m) for i, (n, _, m) in enumerate(rows)}
    if sum(floors.values()) <= size:
        assert all(got[c] >= floors[c] for c in got)
        last = [(got[c] - 0.5) / rows[int(c)][1] for c in got if got[c] > floors[c]]
        following = [(got[c] + 0.5) / rows[int(c)][1] for c in got if got[c] < available[c]]
        assert not last or not following or max(last) <= min(following) + 1e-9


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [
        ('{"a": 1, "b": "X y"}', '{"b":"x-Y!","a":1.0}', True),
        ('{"a": [0.10, 1e1]}', '{"a":[0.1,10]}', True),
        ('{"a": "1"}', '{"a": 1}', False),
        ('{"a": true}', '{"a": 1}', False),
        ('{"a": null}', '{"a": ""}', False),
        ('{"a": "\\u00e9"}', '{"a": "É"}', True),
        ('{"a": 1}', '{"A": 1}', False),
    ],
)
def test_canonical(a, b, equal):
    assert (formatting.canonical(a) == formatting.canonical(b)) is equal


def test_copies_of_one_hot_record(spark):
    rows = [(i, '{"q": "What is it%s", "n": %s}' % ("?" * (i % 3), "7" if i % 2 else "7.0")) for i in range(900)] + [(1000, "{broken"), (1001, None), (1002, '{"q": "alone"}'), (1003, "[1]"), (1004, "[1.0]")]
    out = formatting.copies(spark.createDataFrame(rows, "raw_id bigint, payload string"))
    got = {r.raw_id: (r.first_id, r.n_copies) for r in out.collect()}
    assert len(got) == 903 and got[899] == (0, 900) and got[1002] == (1002, 1) and got[1004] == (1003, 2)


BASIC = pairs.basic_profiles()


@pytest.mark.parametrize(
    ("q", "a", "t", "want"),
    [
        ("How many ships are visible?", None, "2", "empty"),
        ("How many ships are visible?", "  —", "2", "empty"),
        ("How many ships are visible?", "Answer:", "2", "empty"),
        ("How many ships are visible?", "[ERROR] not found: x.png", "2", "empty"),
        ("How many ships are visible?", "2", "2", None),
        ("How many ships are visible?", "None", "2", None),
        ("How many ships are visible near the quay?", "Question: how many ships are visible near the quay?", "2", "copies_question"),
        ("How many ships are visible near the quay?", "Visible near the quay how many ships are", "2", "copies_question"),
        ("Is a red ship present near the old quay?", "Yes, a red ship is present near the old quay.", "Yes", None),
        ("Which ship is near?", "I'm sorry, but I can't help with that request.", "x", "refusal"),
        ("Are there ships?", "I cannot see any ships there; the area is bare.", "Yes", None),
        ("Are there ships?", "Sorry to say, none: the canal holds no ships.", "Yes", None),
        ("Wie viele Schiffe liegen dort?", "Ich kann diese Frage leider nicht beantworten.", "3", "refusal"),
        ("Where is the ship?", "Auf der linken Seite liegt ein Hafen.", "left", "other_language"),
        ("Where is the ship?", "右下角", "left", "other_language"),
        ("Wo liegt das Schiff neben dem Hafen?", "None are visible at this resolution.", "links", "other_language"),
        ("Where is the ship?", "The ship lies at the (", "left", "truncated"),
        ("Where is the ship?", "The ship lies next to the", "left", "truncated"),
        ("Where is the ship?", 'The "ship" lies “close to', "left", "truncated"),
        ("Where is the ship?", "top-left", None, None),
        (None, "a long answer without a question.", None, None),
    ],
)
def test_defects_of_a_row(q, a, t, want):
    assert pairs.judge(q, a, t, BASIC)[0] == want


def test_truncated_by_form(spark):
    whole = [(i, f"What color is the ship near N{i}?", f"The ship near N{i} is painted {c}{'.' if i % 3 else ''}", c) for i, c in enumerate(["red", "blue"] * 30)]
    cut = [(100 + i, f"What color is the ship near M{i}?", s, "red") for i, s in enumerate(("The ship near M0 is pai", "The ship near", "The ship near M2 is painted"))]
    out = {r.rec_id: r.defect for r in pairs.defects(spark.createDataFrame(whole + cut, "rec_id bigint, question string, answer string, ground_truth string")).collect()}
    assert out == {100: "truncated", 101: "truncated", 102: "truncated"}


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(f"{encoding.FOLDER}/{encoding.NAME}.tiktoken"):
        pytest.skip("no tokenizer files")
    return encoding.load_ranks()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc the ünï 你\n", min_size=1, max_size=300))
def test_segment_tree_merges_like_the_plain_rule(ranks, text):
    piece = text.encode()
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    assert encoding.merge_piece(piece, ranks) == [ranks[p] for p in parts]


def test_encoder_extremes(spark, ranks):
    rows = [(1, None), (2, ""), (3, "   "), (4, "a" * 200_000), (5, "<|endoftext|>")]
    out = {r.k: r.ids for r in encoding.encode(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert out[1] is None and out[2] == [] and len(out[3]) >= 1 and len(out[4]) > 1000 and 50256 not in out[5]
    inverse = {v: k for k, v in ranks.items()}
    assert b"".join(inverse[i] for i in out[4]) == b"a" * 200_000


def test_leaks_need_signatures(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(words[5:30]))], "item_id bigint, passage string")
    assert leakage.leaks(docs, items).count() == 1
    monkeypatch.setattr(leakage, "candidates", lambda d, i, *_: d.join(i.withColumnRenamed("id", "item_id").drop("text"), F.lit(False)).select(F.col("id").alias("doc_id"), "item_id"))
    assert leakage.leaks(docs, items).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c".split()), max_size=40), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("a b".split()), max_size=16), min_size=1, max_size=5))
def test_leaks_of_repeated_words(spark, docs, items):
    got = leakage.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string"), spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id bigint, passage string"))
    runs = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, d in enumerate(docs) for j, p in enumerate(items) if runs(d) & runs(p)}


def test_short_items_are_contained(spark):
    docs = [(1, "the old quay of Tamo is wide and grey today"), (2, "Quay, old!"), (3, None), (4, "nothing")]
    items = [(1, "Tamo"), (2, "old quay"), (3, "the old quay of Tamo is wide"), (4, ""), (5, None), (6, "quay old")]
    got = leakage.contained(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (2, 6)}


def test_bins_keep_the_bound():
    for need, agree in ((8, 2), (4, 2), (1, 1)):
        x = leakage.load(need, agree)
        p = (1 - math.exp(-x)) / x
        assert sum(math.comb(need, i) * p**i * (1 - p) ** (need - i) for i in range(agree)) <= 2e-6


def test_levels_only_refine(spark):
    rows = [(i, json.dumps({"q": f"Name {i % 5} of N{i // 2}", "n": i % 2})) for i in range(40)] + [(100, '{"q":"a b"}'), (101, '{"q":"B-A"}'), (102, "{")]
    got = {r.level: r for r in formatting.refinement(spark.createDataFrame(rows, "raw_id bigint, payload string")).collect()}
    assert got["shape"].lines == 42 and got["shape"].survivors == got["letters"].lines >= got["letters"].survivors == got["digest"].lines >= got["digest"].survivors


def test_leaks_need_twelve_words(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "x y " + " ".join(f"W{i}," for i in range(5, 17)) + " z"), (2, " ".join(f"w{i}" for i in range(5, 16)) + " other w16 w17"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(5, 16)) + " w16" * 3), (6, "w1 " * 50_000)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, passage), (10, None), (11, "short one")], "item_id bigint, passage string"))
    assert sorted(map(tuple, got.collect())) == [(1, 9), (5, 9)]


TEXTS = ["Le café à côté du château est fermé en août.", "Die Straße über den Fluss führt nördlich zur Mühle.", "La región pequeña se unió a la montaña después.", "Тень от башни закрывает часть дороги у реки.", "分辨率约为十厘米，适合检测小目标。", "The pier’s shadow hides “part” of the quay – 5 m² at 3 °C."]


def test_garbled_is_found_and_restored(spark):
    clean = [(i, TEXTS[i % len(TEXTS)]) for i in range(600)]
    damage = [("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8")]
    bad = []
    for k, t in enumerate(TEXTS):
        for wrong, _ in damage:
            try:
                bad.append((1000 + len(bad), t.encode("utf-8").decode(wrong), t))
            except UnicodeDecodeError:
                continue
    bad.append((2000, TEXTS[3].encode("cp1251").decode("latin-1"), TEXTS[3]))
    bad.append((2001, TEXTS[4].encode("gb18030").decode("latin-1"), TEXTS[4]))
    bad.append((2002, TEXTS[0].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"), TEXTS[0]))
    bad.append((2003, TEXTS[2].encode("latin-1").decode("utf-8", "replace"), TEXTS[2]))
    extra = [(3000, None), (3001, ""), (3002, "plain"), (3003, "caf&eacute; 22&deg;"), (3004, "MAÇÃ\xa0NO MURAL"), (3005, "é " * 50_000)]
    df = spark.createDataFrame([(i, t) for i, t in clean] + [(i, t) for i, t, _ in bad] + extra, "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in garbled.garbled(df, "doc_id", "text").collect()}
    want = {i: t for i, _, t in bad}
    assert got.keys() == want.keys()
    assert sum(got[i] == want[i] for i in want) >= len(want) - 1


@pytest.mark.parametrize(("true", "wrong"), [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251")])
def test_copies_of_a_damaged_text_are_all_found(spark, true, wrong):
    bad = TEXTS[3].encode(true).decode(wrong)
    rows = [(i, f"{TEXTS[i % len(TEXTS)]} {i}") for i in range(600)] + [(1000 + i, bad) for i in range(300)]
    got = {r.doc_id: r.restored for r in garbled.garbled(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {1000 + i: TEXTS[3] for i in range(300)}


def test_unclosed():
    for text in ("a (b", "“a", "```x (y)", "x [a (b) c", 'say "so', "<b>bold", "see <a href=", "First:\n1. one\n2.", "<note>x</b>"):
        assert pairs.unclosed(text), text
    for text in ("a) (b) “c”", "```x (y```", '5" wide and 6" high', "<b>x</b><br>", "1. one\n2. two", "(a [b)", 'the "old" quay', "-", "x < y"):
        assert not pairs.unclosed(text), text


def test_profiles_are_learned_from_the_rows(spark):
    rows = [(i, f"¿Hay grulajos en la zona de K{i}?", f"Sí, hay grulajos en la zona de K{i}.", "Sí") for i in range(60)] + [(100 + i, f"Is there a crane at the quay of K{i}?", f"Yes, there is a crane at K{i}.", "Yes") for i in range(200)]
    rows += [(900, "Is there a crane at the quay of Z?", "Grulajos zona", "Yes")]
    df = spark.createDataFrame(rows, "rec_id bigint, question string, answer string, ground_truth string")
    assert {r.rec_id: r.defect for r in pairs.defects(df).collect()} == {900: "other_language"}
    assert pairs.judge("Is there a crane at the quay of Z?", "Grulajos zona", "Yes", BASIC)[0] is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=30), st.lists(st.sampled_from("ab"), max_size=30))
def test_common_endings(text, end):
    def plain(j):
        k = 0
        while k <= j and k < len(end) and text[j - k] == end[-1 - k]:
            k += 1
        return k

    assert pairs.common_endings(text, end) == [plain(j) for j in range(len(text))]


def test_values_of_other_rows_are_known_however_rare(spark):
    rows = [(i, f"What color is the ship near N{i}?", f"The ship near N{i} is painted {c}.", c) for i, c in enumerate(["red", "blue"] * 30)]
    rows += [(100, "What color is the ship near M?", "The ship near M is painted pale mauve", "red"), (101, "What stands there?", "pale mauve", "pale mauve")]
    df = spark.createDataFrame(rows, "rec_id bigint, question string, answer string, ground_truth string")
    assert pairs.defects(df).count() == 0
    assert pairs.defects(df.where("rec_id <> 101")).count() == 1


def test_tiles():
    a, b = pairs.tiles("a b c d".split(), "c d x a b".split(), 2)
    assert a == [True] * 4 and b == [True, True, False, True, True]
    assert np.sum(pairs.tiles([], ["x"], 1)[1]) == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 3))
def test_long_tiles_are_tiles(a, b, least):
    assert pairs.long_tiles(a, b, least) == pairs.tiles(a, b, least)


@pytest.mark.parametrize("n", [60, 600, 6000])
def test_copies_of_any_length_with_words_changed(n):
    words = [f"w{i}" for i in range(n)]
    assert pairs.copies_question(words, [words[i - 1] if i % 8 == 7 else w for i, w in enumerate(words)], [])


def test_damage_comes_from_the_lattice(spark, monkeypatch):
    bad = TEXTS[0].encode("utf-8").decode("cp1252")
    lost = TEXTS[2].encode("latin-1").decode("utf-8", "replace")
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(1000, bad), (1001, lost)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in garbled.garbled(df, "doc_id", "text").collect()} == {1000: TEXTS[0], 1001: TEXTS[2]}
    monkeypatch.setattr(garbled, "only_way", lambda *_: None)
    monkeypatch.setattr(garbled.Lattice, "best", lambda *_: None)
    assert {r.doc_id: r.complete for r in garbled.garbled(df, "doc_id", "text").collect()} == {1001: False}


def test_lost_bytes_are_filled_in_any_channel():
    counts = garbled.Counts(np.zeros((5, 1 << garbled.BITS), np.int64), "äéñсть分辨率")
    for text in ("Während", "señal", "часть", "分辨率"):
        for u in garbled.units(text):
            for x in [u, *(garbled.beginnings(u) if len(u) > 1 else [])]:
                a, b = garbled.places(x)
                counts.rows[:4, [a, b, a, b]] = 50
    counts = garbled.Counts(counts.rows, "äñчасть分辨率")
    decoder = garbled.Decoder(counts)
    assert decoder.decode("W\ufffdhrend")[0] == "Während"
    broken = "часть".encode("utf-8").decode("cp1252", "replace")
    assert "\ufffd" in broken and decoder.decode(broken)[0] == "часть"
    assert decoder.decode("q\ufffdz")[0] == "q\ufffdz"


def test_pairs_come_from_the_fingerprints(spark, monkeypatch):
    rows = [("question", "p", i, i < 2, f"how many ships lie at quay of {'Tamo' if i % 2 else 'Rena'}{' now' if i > 1 else ''}".split()) for i in range(4)]
    df = spark.createDataFrame(rows, "kind string, place string, key bigint, train boolean, words array<string>")
    assert crosssplit.near_pairs(df).count() == 2
    monkeypatch.setattr(crosssplit, "fingerprints", lambda share: F.array().cast("array<struct<f:bigint,i:int>>"))
    assert crosssplit.near_pairs(df).count() == 0


def test_shortfalls_come_from_drawn_ranks(spark, monkeypatch):
    items = spark.createDataFrame([("f", i, "a" if i % 4 else "b") for i in range(80)], "field string, key bigint, category string")
    targets = spark.createDataFrame([("f", "a", 0.5, 2), ("f", "b", 0.9, 1), ("f", "c", 0.1, 3)], "field string, category string, target_share double, min_count int")
    plan = sampling.sample_plan(items, targets, part=0.5)
    assert {r.category: (r.drawn, r.short) for r in sampling.shortfalls(items, plan).collect()} == {"a": (20, False), "b": (20, True), "c": (0, True)}
    monkeypatch.setattr(sampling, "rank_in_hash_order", lambda df, *_: df.withColumn("rank", F.lit(1).cast("bigint")))
    assert {r.category for r in sampling.shortfalls(items, plan).collect() if r.short} == {"a", "b", "c"}
