import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import external as X
from lectern.functions import names as N
from lectern.functions import text as T
from lectern.operators import curate as C
from lectern.operators import runs as R
from lectern.operators import similar as S
from lectern.operators import splits as P
from lectern.operators import training as M
from lectern.plans import curation
from lectern.sources import config, readers, sinks


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.05, 0.15, 0.35, 0.6, 0.95, 1.0, 1.0000001)], "v double")
    assert [r[0] for r in df.select(C.bins005(F.col("v"))).collect()] == [None, 0, 1, 3, 7, 12, 19, 19, None]


def test_length_histogram_tail_and_overlap(spark):
    df = spark.createDataFrame([("a", x) for x in (10, 60, 120)], "type string, v int")
    rows = {r["interval"]: r["count"] for r in C.length_histogram(df, "v", "type").collect()}
    assert rows == {"0 ~ 50": 1, "50 ~ 100": 1, "100 ~ 150": 0, ">= 120": 1}
    rows = {r["interval"]: r["count"] for r in C.length_histogram(df, "v", "type", overlap=True).collect()}
    assert rows["100 ~ 150"] == 1 and rows[">= 120"] == 1
    assert C.length_histogram(df.where("v < 0"), "v", "type").count() == 0


def test_filters_are_inclusive_and_idempotent(spark):
    df = spark.createDataFrame([("ab", "abc"), ("abc", "a"), ("abcd", "a")], "question string, answer string")
    kept = C.length_filter(df, pair=3)
    assert kept.count() == 2 and C.length_filter(kept, pair=3).count() == 2
    with pytest.raises(ValueError):
        C.length_filter(df, pair=0)


def test_summary_of_nothing_is_zero(spark):
    row = C.summary(spark.createDataFrame([], "v double"), "v").first()
    assert (row["n"], row["mean"], row["median"], row["max"]) == (0, 0.0, 0.0, 0.0)


def greedy(n, edges):
    near = {}
    for i, j in edges:
        near.setdefault(j, set()).add(i)
    gone = set()
    for j in range(n):
        if any(i not in gone for i in near.get(j, ())):
            gone.add(j)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_a_scan(spark, seed):
    r = random.Random(seed)
    edges = {(i, j) for i, j in (sorted(r.sample(range(40), 2)) for _ in range(70))}
    got = {x["node"] for x in S.greedy_rounds(spark.createDataFrame(list(edges), "i long, j long")).where("removed").collect()}
    assert got == greedy(40, edges)


def test_greedy_on_nothing(spark):
    df = spark.createDataFrame([], "id long, t string, v array<double>")
    kept, pairs = S.greedy_dedup(df, "id", "t", "v", 0.5)
    assert kept.count() == 0 and pairs.count() == 0


def test_similar_pairs_blocks_do_not_matter(spark):
    r = random.Random(1)
    rows = [(i, "ab"[i % 2], [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, "a", [0.0] * 8), (61, None, [1.0] * 8), (62, "a", None)]
    df = spark.createDataFrame(rows, "id long, t string, v array<double>")
    a = {(x["i"], x["j"]): round(x["sim"], 9) for x in S.similar_pairs(df, "id", "t", "v", 0.1).collect()}
    b = {(x["i"], x["j"]): round(x["sim"], 9) for x in S.similar_pairs(df, "id", "t", "v", 0.1, block=7).collect()}
    assert a == b and a and all(i < j for i, j in a)


def test_sampled_pairs_are_distinct_and_complete(spark):
    df = spark.createDataFrame([(i, "a") for i in range(200)] + [(i, "b") for i in range(4)] + [(0, "c")], "id long, f string")
    rows = [(r["f"], r["i"], r["j"]) for r in S.sampled_pairs(df, "id", "f", 20, 7).collect()]
    assert len(rows) == len(set(rows)) == 26
    assert sorted(x[1:] for x in rows if x[0] == "b") == list(itertools.combinations(range(1, 5), 2))
    assert all(1 <= i < j <= 200 for f, i, j in rows)


def test_splits_are_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    got = {r["split"]: r["count"] for r in P.test_split(df, "k", 0.2).groupBy("split").count().collect()}
    assert got == {"test": 201, "train_eval": 802}
    assert P.test_split(df, "k", 0.0).where("split = 'test'").count() == 0
    a = P.resplits(df, "k", 0.125, [0]).where("part = 'eval'")
    b = P.resplits(df, "k", 0.125, [1]).where("part = 'eval'")
    assert a.count() == b.count() == 126 and a.join(b, "k").count() < 126


def test_quota_plan_of_the_published_lectures(spark):
    counts = [7, 6, 7, 5, 8, 5, 8, 6, 11, 12]
    rows = [(f"{i + 1:02d}", k) for i, n in enumerate(counts) for k in range(n)]
    plan = P.quota_plan(spark.createDataFrame(rows, "file string, section_no int"), "file")
    assert plan.agg(F.sum("n")).first()[0] == 9905
    assert [r["s"] for r in plan.groupBy("file").agg(F.sum("n").alias("s")).orderBy("file").collect()] == [986, 990, 986, 1000, 988, 1000, 988, 990, 993, 984]


def test_every_question_of_the_quota_is_asked(spark):
    rows = [("a", 0, "## x"), ("a", 1, "## y")] + [("b", i, f"## {i}") for i in range(120)]
    asked = P.asked(spark.createDataFrame(rows, "file string, section_no int, section string"), "file")
    got = X.in_sequence(asked, ["file", "section_no", "type"], "n", X.echo_generator("?")).collect()
    plan = P.quota_plan(spark.createDataFrame([r[:2] for r in rows], "file string, section_no int"), "file").collect()
    count = {}
    for x in got:
        count.setdefault((x["file"], x["section_no"], x["type"]), []).append(x["no"])
    assert {k: sorted(v) for k, v in count.items()} == {(x["file"], x["section_no"], x["type"]): list(range(1, x["n"] + 1)) for x in plan if x["n"]}
    prompts = {(x["file"], x["section_no"]): x["prompt"].split("\n", 1)[1] for x in asked.collect()}
    assert prompts["a", 1] == "## y" and prompts["a", -1] == "## x\n## y" and prompts["b", -1] == "\n".join(f"## {i}" for i in range(120))


def test_sections(spark):
    text = "intro\n## a  \nx\t\n### in\n##no\n## \n## ---\nlast\n"
    rows = readers.sections(spark.createDataFrame([(1, text), (2, "no section"), (3, None)], "id long, text string"), "id", "text").collect()
    assert [(r["id"], r["section_no"], r["section"]) for r in rows] == [(1, 0, "## a\nx\n### in\n##no\n##"), (1, 1, "## ---\nlast")]


def test_jsonl(spark, tmp_path):
    lines = ['{"type":"t","question":" q　","answer":"a"}', "", "bad{", "[1]", '{"question":"q"}', '{"question":5,"answer":"a"}', '{"question":"  ","answer":"a"}', '{"type":null,"question":"q2","answer":"a2"}']
    (tmp_path / "sub").mkdir()
    (tmp_path / "01 x.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "sub" / "02.jsonl").write_text('{"question":"z","answer":"z"}\n', encoding="utf-8")
    rows = readers.read_pairs(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r["row_id"], r["line_no"], r["type"], r["question"]) for r in rows] == [(0, 1, "t", "q"), (1, 8, "", "q2"), (2, 1, "", "z")]
    skipped = {r["path"].rsplit("/", 1)[-1][:2]: (r["valid"], r["skipped"]) for r in readers.skipped(readers.parsed(readers.jsonl_lines(spark, str(tmp_path)))).collect()}
    assert skipped == {"01": (2, 5), "02": (1, 0)}
    assert readers.read_pairs(spark, str(tmp_path), strict_file=True).count() == 1
    with pytest.raises(Exception):
        readers.read_strict(spark, str(tmp_path)).collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "问", "答"), (1, "a", "q", "a")], "row_id long, type string, question string, answer string")
    sinks.write_filtered(df, str(tmp_path / "f"))
    assert sorted(r["question"] for r in spark.read.json(str(tmp_path / "f")).collect()) == ["q", "问"]
    sinks.write_csv(spark.createDataFrame([("0 ~ 50", 1.5)], "Interval string, x double"), str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfInterval")


def test_logs_and_config(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\nrun_name: 'one'\nrun_name: two\n")
    lines = readers.jsonl_lines(spark, str(tmp_path), "*.log")
    assert [r["value"] for r in readers.logged_values(lines, ["run_name"]).collect()] == ["one"]
    assert config.overrides(["--a.b=3"]) == {"a.b": 3}
    with pytest.raises(ValueError):
        config.check_split(0.5, 0.5, 0.5)
    paths = spark.createDataFrame([("/r/a/b/x.bin",)], "path string")
    confs = spark.createDataFrame([("/r/c.yaml",), ("/r/a/c.yaml",)], "path string")
    assert config.nearest_config(paths, confs).first()["config"] == "/r/a/c.yaml"


def test_training_rows(spark):
    df = spark.createDataFrame([("abc", "de"), ("abcdefgh", "x")], "p string, r string")
    rows = M.masked_rows(df, M.token_codes(F.col("p")), M.token_codes(F.col("r")), 4).collect()
    assert rows[0]["labels"] == [-100, -100, -100, 100] and rows[1]["labels"] == [-100] * 4 and rows[0]["attention_mask"] == [1] * 4


def test_best_checkpoint_ties_and_nan(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 0.5), (1, 3, 0.5), (2, 1, float("inf"))], "run int, step int, loss double")
    assert [(r["run"], r["step"]) for r in R.best_checkpoint(df, "run").collect()] == [(1, 2)]


def test_text_pipeline_equals_a_scan(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, r.choice(["s", "t"]), " ".join(r.choice(words) for _ in range(4)), " ".join(r.choice(words) for _ in range(4))) for i in range(60)]
    limits = [("s", 0.3, 0.6), ("t", 0.2, 0.9)]
    df = spark.createDataFrame(rows, "row_id long, type string, question string, answer string")
    got = curation.text_pipeline(df, "row_id", X.apply(X.hashing_embedder(), "array<double>"), spark.createDataFrame(limits, "type string, qa_lower double, qq_upper double"))
    got = {x["row_id"] for x in got.collect()}
    embed = X.hashing_embedder()()
    dot = lambda a, b: sum(x * y for x, y in zip(*embed([a, b])))
    want, gone = set(), 0
    for kind, low, up in limits:
        kept = []
        for i, t, q, a in rows:
            if t == kind and not any(dot(q, k) > up for k in kept):
                kept.append(q)
                want |= {i} if dot(q, a) >= low else set()
            elif t == kind and dot(q, a) >= low:
                gone += 1
    assert got == want and gone


def test_memoised_seam(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    rows = X.memoised(df, "t", "v", X.apply(X.hashing_embedder(8), "array<double>")).collect()
    assert len(rows) == 3 and all(len(r["v"]) == 8 for r in rows)
    assert X.with_retry(lambda t: 1 / 0, tries=2)(["x"]) == [None]


def test_streaming_keeps_first_of_equal_pairs(spark, tmp_path):
    from lectern.streaming import ingest

    (tmp_path / "in").mkdir()
    rows = [{"at": f"2024-01-01T00:0{i}:00Z", "question": q, "answer": "a"} for i, q in enumerate(["x", "x", "y", " "])]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), "at timestamp, question string, answer string")
    ingest.run_once(ingest.valid_once(stream, "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["question"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_overfit_indicator(spark):
    assert spark.range(1).select(T.overfit_indicator(F.lit(1.0), F.lit(0.1))).first()[0] == pytest.approx(1.0)


def test_splits_take_the_smallest_ranks_at_every_share(spark):
    df = spark.range(137).withColumnRenamed("id", "k")
    order = [r["k"] for r in df.orderBy(T.hash_rank(42, F.col("k"))).collect()]
    for share in (0.0, 0.01, 0.2, 0.5, 1.0):
        got = {r["k"] for r in P.test_split(df, "k", share).where("split = 'test'").collect()}
        assert got == set(order[: -int(-(137 * share) // 1)])
    assert P.test_split(df.where("k < 0"), "k", 0.2).count() == 0
    both = P.resplits(df, "k", 0.125, [0, 1])
    assert both.count() == 274 and both.where("part = 'eval'").groupBy("split_id").count().where("count = 18").count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"type": "t", "question": f"q{i}", "answer": "a" * (i % 50)}) if i % 7 else "" for i in range(4000)]
    for name in ("01 a.jsonl", "02 b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        df = readers.jsonl_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = {(r["path"][-10:-6], r["line_no"]): r["line"] for r in df.collect()}
        rows = readers.read_pairs(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 8000 and all(got[(f, i + 1)] == x for f in {k[0] for k in got} for i, x in enumerate(lines))
    good = [i + 1 for i, x in enumerate(lines) if x and json.loads(x)["answer"]]
    assert [r["row_id"] for r in rows] == list(range(2 * len(good))) and [r["line_no"] for r in rows] == good * 2


def test_only_the_own_folder_of_a_named_data_set_is_read(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    line = json.dumps({"type": "t", "question": "q", "answer": "a"})
    (tmp_path / "a" / "x.jsonl").write_text(line)
    (tmp_path / "a" / "deep" / "y.jsonl").write_text(line)
    assert readers.read_labelled(spark, {"one": str(tmp_path / "a")}).count() == 1
    assert [f.rsplit("/", 1)[-1] for f in readers.data_files(spark, str(tmp_path))] == ["y.jsonl", "x.jsonl"]
    assert readers.read_inferred(spark, str(tmp_path)).columns == ["answer", "question", "type"]
    for missing in (tmp_path / "none", tmp_path / "a" / "deep" / "z"):
        with pytest.raises(FileNotFoundError):
            readers.data_files(spark, str(missing))
    with pytest.raises(FileNotFoundError):
        readers.data_files(spark, str(tmp_path), "*.csv")


def test_sidecars(spark, tmp_path):
    for i, kind in enumerate(("LORA", "PREFIX")):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "adapter_config.json").write_text(json.dumps({"peft_type": kind}, indent=1))
    got = {r["folder"].rsplit("/", 1)[-1]: r["peft_type"] for r in readers.read_sidecars(spark, str(tmp_path), "adapter_config.json").collect()}
    assert got == {"c0": "LORA", "c1": "PREFIX"}


def test_replacing_keeps_the_old_table_until_the_new_one_stands(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_replacing(spark.range(3), path)
    sinks.write_replacing(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        sinks.write_replacing(spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_logs_and_snapshots(tmp_path):
    assert sinks.block_text({"a": 1, "b": {"c": [1, {"d": 2}]}, "e": []}, "t") == "t\n  a: 1\n  b:\n    c:\n      - 1\n      -\n        d: 2\n  e:"
    assert sinks.block_text("x", "n") == "n: x" and sinks.block_text([1]) == "list\n  - 1"
    sinks.append_log(str(tmp_path / "l"), "一")
    sinks.append_log(str(tmp_path / "l"), {"k": 2})
    assert (tmp_path / "l").read_text() == "一\ndict\n  k: 2\n"
    sinks.snapshot({"b": 1, "a": {"x": "中"}}, str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == {"b": 1, "a": {"x": "中"}}


def settings():
    train = {"num_epochs": 1, "batch_size": 2, "gradient_accumulation_steps": 1, "learning_rate": 0.1}
    return {
        "global": {**{k: 1 for k in config.REQUIRED["global"]}, "train_size": 0.7, "eval_size": 0.1, "test_size": 0.2},
        "LoRA": {"rank": 4, "alpha": 8, "scaling_type": "r/a", "dropout_rate": 0.1, "target_modules": ["q"], "init_lora_weights": True, **train},
        "PrefixFT": {"num_virtual_tokens": 3, "prefix_projection": False, "init_weights": True, **train},
        "AdapterFinetuning": {"target_modules": "x", "adapter_len": 3, "adapter_layers": 2, **train},
    }


@pytest.mark.parametrize(
    "section,key,value",
    [("LoRA", "rank", 0), ("LoRA", "dropout_rate", 1), ("LoRA", "target_modules", []), ("LoRA", "scaling_type", "x"), ("LoRA", "target_layer_side", "up"), ("LoRA", "target_layer_side", "input"), ("LoRA", "target_layer_count", 2), ("global", "train_size", 0.9), ("global", "eval_size", 0), ("global", "test_eval_epochs", -1), ("PrefixFT", "num_epochs", 0), ("AdapterFinetuning", "target_modules", " "), ("PrefixFT", "num_virtual_tokens", "many")],
)
def test_configuration_is_checked(section, key, value):
    assert config.problems(settings()) == []
    config.check(settings(), "LoRA")
    bad = settings()
    bad[section][key] = value
    assert config.problems(bad)
    with pytest.raises(ValueError):
        config.check(bad, "LoRA")
    del bad[section]
    assert any("missing" in x for x in config.problems(bad))


def test_columns_paths_and_methods(spark, tmp_path):
    with pytest.raises(ValueError, match="answer"):
        config.check_columns(spark.range(1), "id", "answer")
    with pytest.raises(ValueError):
        config.check(settings(), "other")
    (tmp_path / "m").mkdir()
    assert config.resolved("m", str(tmp_path)) == str(tmp_path / "m") and config.resolved(None, "x") is None
    assert config.model_path("m", "/nowhere", str(tmp_path)) == str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        config.model_path("none", str(tmp_path), str(tmp_path))


def test_numbers_as_six_significant_digits(spark):
    cases = [0.1234567, 1e-5, 123456.7, 1234567.8, 2.5, 3.0, 0.0, -0.00012345678, 100.5, 1.5e-10, 99999.96, -2.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in cases], "x double").select(N.number(F.col("x"))).collect()]
    assert got == [str(int(x)) if x.is_integer() else f"{x:g}" for x in cases]


def test_funnel_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (None, "b")], "n int, x string")
    rows = {r["stage"]: r["n"] for r in C.funnel(df, [("raw", F.lit(True)), ("numbered", F.col("n").isNotNull())], distinct=("distinct", F.col("x"))).collect()}
    assert rows == {"raw": 4, "numbered": 3, "distinct": 1}
    assert [r["n"] for r in C.funnel(df.where("n > 9"), [("raw", F.lit(True))]).collect()] == [0]


def test_run_counters(spark):
    got = R.run_counters(spark.createDataFrame([("a", "b"), ("c", "c")], "old string, new string")).first()
    assert (got["converted"], got["skipped"]) == (1, 1)


def test_folders_are_swept(spark):
    from lectern import storage

    a = storage.written(spark.range(3), "t")
    b = storage.written(a, "t", instead_of=a)
    assert not storage.exists(spark, a._lectern_folder) and b.count() == 3
    storage.sweep(b._lectern_folder)
    assert not storage.exists(spark, b._lectern_folder)


def test_greedy_scan_lists_no_pairs_of_a_family(spark, monkeypatch):
    from lectern.operators import similar

    r = random.Random(11)
    rows = [(i, r.choice("st"), [r.choice([1.0, 1.0, 0.9, 0.2]) for _ in range(6)]) for i in range(900)] + [(-5, "s", None), (1000, "t", [0.0] * 6), (1001, "t", [0.0] * 6)]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    cos = lambda a, b: float(np.dot(a, b) / max(1e-30, np.linalg.norm(a) * np.linalg.norm(b)))
    kept, pairs = {}, {}
    for k, g, v in sorted(rows):
        near = [i for i in kept if v and kept[i][1] and kept[i][0] == g and cos(kept[i][1], v) > 0.97]
        if near:
            pairs[k] = min(near)
        else:
            kept[k] = (g, v)
    listed = []
    whole = similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda *a, **b: listed.append(1) or whole(*a, **b))
    got, gone = similar.greedy_dedup(df, "k", "g", "v", 0.97, first=30)
    assert {x["k"] for x in got.collect()} == set(kept) and {x["j"]: x["i"] for x in gone.collect()} == pairs
    assert len(pairs) > 300 and not listed
    got, gone = similar.greedy_dedup(df, "k", "g", "v", 0.97, first=200, scan=40)
    assert {x["k"] for x in got.collect()} == set(kept) and {x["j"]: x["i"] for x in gone.collect()} == pairs
    assert listed
