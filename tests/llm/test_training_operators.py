import os
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import abuse, encoding, near_duplicates, overlap, packing, pair_defects, proportional, queries, splitting
from lectern.llm.common import joined_letters, letter_table, string_parts, strings, text_hashes
from lectern.llm.tokenizers import byte_bpe

DATA = "/root/testdata/sf0.001"
DDL = {
    "qa_pairs": "row_id long, _file string, line_no int, type string, question string, answer string, created_at timestamp, loaded_at timestamp, k int, cls string, n int",
    "split_rows": "sample_id long, split string, source string, question string, answer string, created_at timestamp, loaded_at timestamp, held int, a int",
    "chat_messages": "message_id long, conv_id long, turn int, role string, content string, sent_at timestamp, loaded_at timestamp, begin int, piece string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, file_name string, section_no int, added_at timestamp, k int, t string, ids string, score int",
    "doc_labels": "doc_id long, label int, reviewer string, reviewed_at timestamp, source string",
    "type_plan": "type string, target_share double, min_rows int",
    "abuse_terms": "term string, lang string, category string, weight int",
}


def make(spark, path, **tables):
    """A folder of tables: rows are dicts, missing fields null; tables not given are empty."""
    for name, ddl in DDL.items():
        cols = [c.split(" ")[0] for c in ddl.split(", ")]
        rows = [tuple(r.get(c) for c in cols) for r in tables.get(name, [])]
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, make(spark, tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_null_rows(spark, tmp_path, name):
    blank = [{}, {"question": "", "answer": ""}]
    d = make(spark, tmp_path, qa_pairs=[{"row_id": 1}, {"row_id": 1}, *blank], split_rows=[{"sample_id": 1}, {"sample_id": 2, "split": "eval"}, *blank], chat_messages=[{"message_id": 1}, {"content": "x" * 3000}], documents=[{"doc_id": 1}, {"doc_id": 2, "text": ""}], doc_labels=[{"doc_id": 1}, {"label": 1}], type_plan=[{"type": "a"}, {}], abuse_terms=[{}])
    rows = queries.queries()[name](spark, d).collect()
    if name == "p6_ids":
        assert sorted((r["doc_id"], list(r["ids"])) for r in rows) == [(1, []), (2, [])]


def noisy(r, text, edits):
    out = list(text)
    for _ in range(edits):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], [out[i], r.choice("甲乙丙丁xyz7")], [r.choice("戊己庚qrs3")]])
    return "".join(out)


def corpus(seed, n=60, length=160):
    r = random.Random(seed)
    alphabet = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经abcdefghij0123456789"
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(length // 2, length * 2))) for _ in range(n)]
    texts = base + [noisy(r, t, r.randint(1, 8)) for t in base[: n // 2] for _ in range(2)] + base[:3] + base[:1] * 4
    texts += ["短文本一二三", "短文本一二三四", "ab", "ab", "", "abc", "abc"]
    return texts


def jaccards(texts):
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    return {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j]}


def test_p1_equals_brute_force(spark, tmp_path):
    texts = corpus(1)
    d = make(spark, tmp_path, qa_pairs=[{"row_id": i, "question": t[:40], "answer": t[40:] or None} for i, t in enumerate(texts)] * 2)
    want = {p for p, s in jaccards(texts).items() if s >= 0.6}
    got = [(r["row_id_a"], r["row_id_b"]) for r in near_duplicates.p1_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    groups = {r["row_id"]: r["group_id"] for r in near_duplicates.p1_groups(spark, d).collect()}
    assert len(groups) == len(texts) and all(groups[i] == groups[j] for i, j in want)
    classes = {r["row_id"]: r["class_id"] for r in near_duplicates.p1_groups(spark, d).collect()}
    assert classes[0] == classes[len(texts) - 8]


def p1_links(spark, texts, **how):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ids = {h: i for i, h in enumerate(text_hashes(*joined_letters(pa.array(texts))).tolist())}
    return {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in near_duplicates.class_links(df, ["t"], **how).collect()}


def test_p1_large_group_of_long_versions(spark):
    """A third of all texts are versions of one long text: each meets a few of the others, and the group is then compared whole."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    root = word(900)
    texts = [edited(r, root, r.randint(20, 60)) for _ in range(240)] + [word(300) for _ in range(480)]
    want = {p for p, s in jaccards(texts).items() if s >= 0.6}
    got = p1_links(spark, texts)
    assert len(want) > 2 * near_duplicates.FULL * 240 and got <= want and len(got) >= 0.999 * len(want)


def test_p1_template_gives_candidates_in_proportion(spark):
    """Texts that share most of their characters, but none of them enough, meet a bounded number of others each."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    start = word(60)
    for n in (500, 2000):
        df = spark.createDataFrame([(start + word(22),) for _ in range(n)], "t string")
        frequency, m = near_duplicates.frequency_sketch(df)
        signed = near_duplicates._signed(df, ["t"], frequency, m, near_duplicates.UNITS, near_duplicates.LEAST_HITS, 0.6).cache()
        assert signed.distinct().groupBy("sig").count().agg({"count": "max"}).first()[0] == n  # one posting holds them all
        assert near_duplicates.posting_pairs(signed, near_duplicates.FULL).distinct().count() < 200 * n
        assert near_duplicates.candidates(signed, near_duplicates.LEAST_HITS).where("enough").count() < 4 * near_duplicates.FULL * n
        signed.unpersist()


def test_p1_exact_mode_finds_every_pair(spark):
    texts = corpus(7, length=50)
    want = {frozenset((texts[i], texts[j])) for (i, j), s in jaccards(texts).items() if s >= 0.6 and texts[i] != texts[j]}
    assert {frozenset((texts[i], texts[j])) for i, j in p1_links(spark, texts, exact=True)} == want


def test_p1_cells_link_a_large_posting():
    cls = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    a, b = near_duplicates.cell_pairs(cls, 32)
    assert len(a) < 2 * 32 * len(cls)
    seen, todo, links = {cls[0]}, [cls[0]], {}
    for x, y in zip(a.tolist(), b.tolist()):
        links.setdefault(x, []).append(y)
        links.setdefault(y, []).append(x)
    while todo:
        for y in links.get(todo.pop(), []):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert len(seen) == len(cls)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101]], "node long")
    got = {r["node"]: r["component"] for r in near_duplicates.components(links, nodes).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_p2_defects_kept_out(spark):
    import pyarrow.parquet as pq

    if not os.path.isdir(DATA):
        pytest.skip("test data not there")
    t = pq.read_table(f"{DATA}/qa_pairs.parquet").to_pylist()
    pairs = [(x["question"], x["answer"]) for x in t if x["question"] and x["answer"]]
    m = pair_defects.train(pairs[: len(pairs) * 3 // 4])
    qs, as_, ys = pair_defects.Maker(pairs[len(pairs) * 3 // 4 :], seed=99).examples()
    s = pair_defects.scores(*pair_defects._matrix(qs, as_, m.spoken), m.weights)
    y = np.array(ys)
    hit = [(s[y == k + 1, k] > 0).mean() for k in range(len(pair_defects.DEFECTS))]
    assert min(hit[0], hit[2], hit[3], hit[4]) > 0.9 and hit[1] > 0.6, hit


def test_p2_clear_cases(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test data not there")
    rows = spark.read.parquet(f"{DATA}/qa_pairs.parquet").select("row_id", "question", "answer")
    q = "在某书院的作业里，频道之间的关系由 $K_{4}$ 描述，请给出笛卡尔积的定义并说明理由。"
    own = spark.createDataFrame([(-1, q, None), (-2, q, "抱歉，我无法回答这个关于笛卡尔积的问题。"), (-3, q, "题目是：" + q), (-4, None, None)], "row_id long, question string, answer string")
    got = {r["row_id"]: max(pair_defects.DEFECTS, key=lambda d: r[d]) for r in pair_defects.defects(rows.unionByName(own), "row_id", "question", "answer", pair_defects.fitted(rows, "row_id", "question", "answer")).where("row_id < 0").collect()}
    assert got == {-1: "empty", -2: "refusal", -3: "copied", -4: "empty"}


def test_scripts_and_formulas():
    texts = ["$x$", "这是一个中文句子。", "this is the answer that we want", "Обратное неверно, поскольку", "仮定よりこれが成り立ちます", "| i | value |", ""]
    m = pair_defects.Masked(pa.array(texts))
    assert pair_defects.script(m.shares()).tolist() == [0, 1, 4, 3, 2, 0, 0]
    m = pair_defects.Masked(pa.array(["a $x+1", "a $x$ b", "```\nif x", "`x`", None]))
    assert m.open_formula.tolist() == [True, False, False, False, False] and m.open_block.tolist() == [False, False, True, False, False]


def test_p3_equals_brute_force(spark, tmp_path):
    texts = corpus(2, n=80)
    r = random.Random(5)
    split = [r.choice(["train", " Train ", "TRAIN", "eval", "Test "]) for _ in texts]
    split[3] = None
    rows = [{"sample_id": i, "split": s, "source": "s", "question": t} for i, (t, s) in enumerate(zip(texts, split))]
    d = make(spark, tmp_path, split_rows=rows + rows[:20])
    side = [None if s is None else s.strip().lower() == "train" for s in split]
    want = {(i, j) for (i, j), s in jaccards(texts).items() if s >= 0.6 and side[i] is not None and side[j] is not None and side[i] != side[j]}
    got = [(x["sample_id_a"], x["sample_id_b"]) for x in overlap.p3_found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    report = overlap.p3_report(spark, d).collect()
    held = {i for i, s in enumerate(side) if s is False}
    assert sum(x["samples"] for x in report) == len(held)
    assert sum(x["overlapping"] for x in report) == len({i for p in want for i in p if i in held})


def edited(r, text, n):
    """The text with n characters replaced at random places."""
    out = list(text)
    for i in r.sample(range(len(out)), n):
        out[i] = r.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


def p3_recall(spark, path, train, held):
    rows = [{"sample_id": i, "split": "train" if i < len(train) else "test", "source": "s", "question": t} for i, t in enumerate(train + held)]
    want = {p for p, s in jaccards(train + held).items() if s >= 0.6 and p[0] < len(train) <= p[1]}
    got = {(x["sample_id_a"], x["sample_id_b"]) for x in overlap.p3_found(spark, make(spark, path, split_rows=rows)).collect()}
    assert want and got <= want
    return len(got) / len(want)


def test_p3_family_of_a_third_of_the_held_out_texts(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    root = word()
    train, held = [edited(r, root, r.randint(4, 7)) for _ in range(60)], [edited(r, root, r.randint(4, 7)) for _ in range(150)]
    assert p3_recall(spark, tmp_path, train, held + [word() for _ in range(300)]) > 0.99


def test_p3_versions_beside_an_exact_copy(spark, tmp_path):
    r = random.Random(9)
    train = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) for _ in range(40)]
    held = train + [edited(r, t, 7) for t in train for _ in range(8)]
    assert p3_recall(spark, tmp_path, train, held) > 0.99


@pytest.mark.parametrize("many", [400, 4000])
def test_p3_recall_by_length_and_size(spark, tmp_path, many):
    """Pairs of similarity 0.60 to 0.68 are found alike at every length and in a corpus ten times as large."""
    r = random.Random(many)
    word = lambda n: "".join(r.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会abcdefgh") for _ in range(n))
    pairs = []
    while len(pairs) < 240:
        a = word(r.choice([30, 60, 120, 200, 300]))
        b = edited(r, a, max(1, round(len(a) * r.uniform(0.04, 0.1))))
        if 0.6 <= jaccards([a, b]).get((0, 1), 0) <= 0.68:
            pairs.append((a, b))
    rows = [{"sample_id": 2 * i + k, "split": ("train", "eval")[k], "source": "s", "question": t} for i, p in enumerate(pairs) for k, t in enumerate(p)]
    rows += [{"sample_id": 10_000 + i, "split": r.choice(["train", "test"]), "source": "s", "question": word(r.randint(20, 200))} for i in range(many)]
    got = {(x["sample_id_a"], x["sample_id_b"]) for x in overlap.p3_found(spark, make(spark, tmp_path, split_rows=rows)).collect()}
    assert len(got & {(2 * i, 2 * i + 1) for i in range(len(pairs))}) >= 0.99 * len(pairs)


def test_p3_shared_preamble(spark, tmp_path, monkeypatch):
    """Questions that share 60 characters and no more give hardly any candidates, whatever parts their slots are split into."""
    monkeypatch.setattr(overlap, "SHARD_WINDOWS", 300)
    monkeypatch.setattr(overlap, "SHARD_QUERIES", 300)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    start, own = word(60), [word(80) for _ in range(1600)]
    rows = [{"sample_id": i, "split": ("train", "eval")[i % 2], "source": "s", "question": start + t} for i, t in enumerate(own)]
    rows += [{"sample_id": 5000 + i, "split": ("eval", "train")[i % 2], "source": "s", "question": start + edited(r, own[i], 2)} for i in range(100)]
    texts = overlap.side_texts(overlap.sides(spark, make(spark, tmp_path, split_rows=rows)).select("held", "question")).cache()
    parts, total = overlap.shard_sizes(texts)
    assert parts.max() > 1
    routed = overlap.routed_windows(texts, parts).cache()
    assert routed.where("what < (1L << 62)").count() == total
    got = overlap.candidate_pairs(routed, 4, 0.6).count()
    routed.unpersist()
    texts.unpersist()
    assert 100 <= got < 2000


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=overlap.WIDTH), min_size=1, max_size=20), st.text("abcd", min_size=1, max_size=overlap.WIDTH))
def test_backward_search_finds_the_longest_suffix(windows, query):
    def rows(xs):
        return np.array([[0] * (overlap.WIDTH - len(x)) + [ord(c) for c in x] for x in xs], np.uint8)

    index = overlap.BackwardIndex(rows(windows))
    hit, lo, hi, length = index.matches(rows([query]), np.array([1]))
    best = max((len(os.path.commonprefix([w[::-1], query[::-1]])) for w in windows))
    if best == 0:
        assert len(hit) == 0
    else:
        assert length[0] == best
        assert sorted(index.located(np.arange(lo[0], hi[0])).tolist()) == [i for i, w in enumerate(windows) if w.endswith(query[len(query) - best :])]


def test_p4_largest_remainder():
    got = proportional.largest_remainder({"a": 0.5, "b": 0.3, "c": 0.2}, {"c": 5}, {"a": 100, "b": 2, "c": 50}, 20)
    assert {k: q.quota for k, q in got.items()} == {"a": 13, "b": 2, "c": 5} and got["b"].shortfall == pytest.approx(4)
    assert sum(q.quota for q in proportional.largest_remainder({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {}, {"a": 9, "b": 9, "c": 9}, 10).values()) == 10
    assert sum(q.quota for q in proportional.largest_remainder({"a": 1.0}, {}, {"a": 3}, 10).values()) == 3
    assert proportional.largest_remainder({}, {}, {}, 10) == {}


def test_p4_sample(spark, tmp_path):
    names = ["定义解释类"] * 300 + [" 定义解释类", "【定义解释类】", "定义解释", "定义 解释类", "定义解释类（2）", "逻辑推理类", None, "别的东西"]
    d = make(spark, tmp_path, qa_pairs=[{"row_id": i, "type": t} for i, t in enumerate(names)] * 2, type_plan=[{"type": "定义解释类", "target_share": 0.5, "min_rows": 0}, {"type": "逻辑推理类", "target_share": 0.5, "min_rows": 5}])
    report = {r["type"]: r for r in proportional.p4_report(spark, d).collect()}
    assert report["定义解释类"]["available"] == 305 and report["逻辑推理类"]["available"] == 1 and report["逻辑推理类"]["quota"] == 1
    rows = proportional.p4_sample(spark, d).collect()
    assert len(rows) == len({r["row_id"] for r in rows}) == sum(r["quota"] for r in report.values()) == round(0.2 * len(names))
    assert [r["type"] for r in proportional.p4_found(spark, d).collect()] == ["逻辑推理类"]


def scan(text, limit, overlap_):
    """The same cuts one after another, from the successor of each."""
    out, b = [], 0
    cp, off = string_parts(pa.array([text]))
    who, begin, end = splitting.cuts(cp, off, limit, overlap_)
    return list(zip(begin.tolist(), end.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 。.,\n\ŕ‍甲"), max_size=400), max_size=5))
def test_p5_pieces_lose_nothing(texts):
    cp, off = string_parts(pa.array(texts, pa.string()))
    who, begin, end = splitting.cuts(cp, off, 40, 8)
    for i, t in enumerate(texts):
        p = [(b, e) for w, b, e in zip(who.tolist(), begin.tolist(), end.tolist()) if w == i]
        if not t:
            assert not p
            continue
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < e - b <= 40 for b, e in p)
        assert all(0 <= e - b2 <= 8 and e2 > e for (b, e), (b2, e2) in zip(p, p[1:]))
        assert scan(t, 40, 8) == p


def test_p5_prefers_natural_ends():
    text = "甲" * 25 + "。" + "乙" * 30
    assert scan(text, 40, 8)[0] == (0, 26)
    assert scan("x" * 100, 40, 8) == [(0, 40), (32, 72), (64, 100)]
    para = "a" * 22 + "\n\n" + "b" * 5 + ". " + "c" * 30
    assert scan(para, 40, 8)[0] == (0, 24)
    with pytest.raises(ValueError):
        scan("x", 10, 6)


def test_p5_query(spark, tmp_path):
    long = "这是一句话。" * 500
    d = make(spark, tmp_path, chat_messages=[{"message_id": 1, "content": long}, {"message_id": 1, "content": long}, {"message_id": 2, "content": "x" * 2000}, {"message_id": 3, "content": "y" * 2001}])
    assert sorted(r["message_id"] for r in splitting.p5_found(spark, d).collect()) == [1, 3]
    rows = sorted((r for r in splitting.p5_pieces(spark, d).collect() if r["message_id"] == 1), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in rows] == [1, 2] and all(r["piece"] == long[r["begin"] : r["end"]] for r in rows)


TOKENS = os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not TOKENS, reason="vocabulary not there")
@settings(max_examples=40, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab1' \n\t.,我$é🙂's"), st.characters(exclude_categories=["Cs"])), max_size=300), st.data())
def test_p6_joins_are_exact(text, data):
    encode = byte_bpe("byte_bpe_50k").encode_ordinary
    cuts = sorted(data.draw(st.sets(st.integers(1, max(1, len(text) - 1)), max_size=6))) if len(text) > 1 else []
    ends = np.array([*cuts, len(text)], np.int64) if text else np.zeros(0, np.int64)
    known, lo = {}, 0
    for k, hi in enumerate(ends.tolist()):
        chunk = text[lo:hi]
        a, b = encoding.core_of(chunk)
        if a > 0:
            known[k] = (a, b, np.array(encode(chunk[a:b]), np.int32))
        lo = hi
    assert encoding.encode_with(text, ends, known, encode).tolist() == encode(text)


@pytest.mark.skipif(not TOKENS, reason="vocabulary not there")
def test_p6_equals_the_reference_library(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(3)
    words = ["graph", "图论", " edges", "123", "。\n", "'s", "$x_{1}$", "  ", "<|endoftext|>", "é", "🙂"]
    block = "".join(r.choice(words) for _ in range(900))
    texts = [None, "", " ", block, block, "z" + block, block[:700] + "其他" + block[700:], *["".join(r.choice(words) for _ in range(200)) for _ in range(10)]]
    d = make(spark, tmp_path, documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {x["doc_id"]: list(x["ids"]) for x in encoding.p6_ids(spark, d).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}


def test_p6_equal_passages_give_equal_chunks():
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh图论我们 ") for _ in range(4000))
    cp, off = string_parts(pa.array([t, "前缀" + t]))
    a, b = encoding.chunk_ends(cp, off)
    assert len(a) > 5 and len(set((a + 2).tolist()) & set(b.tolist())) >= len(a) - 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_p7_bins(sizes):
    bins = packing.best_two_fit(list(zip(sizes, range(len(sizes)))), 50)
    assert sorted(i for b in bins for _, i in b) == list(range(len(sizes))) and all(sum(n for n, _ in b) <= 50 for b in bins)
    loads = sorted(sum(n for n, _ in b) for b in bins)
    assert len(loads) < 2 or loads[0] + loads[1] > 50


def test_p7_replaces_the_smallest_by_two():
    bins = packing.best_two_fit([(6, "a"), (3, "b"), (2, "c"), (2, "d")], 10)
    assert sorted(x for _, x in bins[0]) == ["a", "c", "d"]


def test_p7_pack(spark):
    sizes = spark.createDataFrame([(1, 5000), (2, 2048), (3, 0), (4, None), (5, 100), (6, 4096)], "doc_id long, n long")
    rows = packing.pack(sizes, "doc_id", "n", groups=2).collect()
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["piece_no"], r["begin"], r["n_tokens"]))
    assert sorted(per[1]) == [(1, 0, 2048), (2, 2048, 2048), (3, 4096, 904)] and per[2] == [(1, 0, 2048)] and len(per[6]) == 2 and set(per) == {1, 2, 5, 6}


def test_p7_containers_are_full(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("test data not there")
    rows = packing.p7_containers(spark, data).collect()
    filled, per = {}, {}
    for r in rows:
        filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
        per.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert max(filled.values()) <= packing.CAPACITY
    assert sum(filled.values()) >= 0.99 * packing.CAPACITY * len(filled)
    assert all(len(x) == -(-sum(x) // packing.CAPACITY) for x in per.values())
    texts = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").select("doc_id").collect()}
    assert set(per) == texts


def test_p8_disguises_and_innocents():
    w = abuse.train([], [], [("idiot", 3)])
    bad = ["You are a worthless idiot and everybody knows it.", "You are a worthless i*d*i*o*t and everybody knows it", "y0u are a w0rthless id1ot and everybody knows it", "你这个白*痴，滚出去。", "你这个白​痴，滚出去。"]
    good = ["The graph is connected and has an even number of edges.", "由鸽巢原理可知，至少有两个节点相同。", "", "$x^2$"]
    s = abuse.doc_scores(bad + good, w)
    assert s[: len(bad)].min() > s[len(bad) :].max()


def test_p8_insult_at_every_place_of_a_long_line():
    w = abuse.train([], [], [("idiot", 3)])
    calm = "we take the next vertex of the graph and follow its edges until the walk closes and then count them again " * 3
    alone = abuse.doc_scores([calm], w)[0]
    lines = [calm[:k] + " You are a worthless idiot and everybody knows it " + calm[k:] for k in range(0, 200, 3)]
    assert abuse.doc_scores(lines, w).min() > max(0, alone)


def test_p8_formulas_hide_nothing():
    assert "tupid" in abuse.without_formulas("You $tupid, u$eless fool") and "begin" not in abuse.without_formulas("by $\\sum_{begin}^{n} x$ we see")
    assert "worthless fool" in abuse.without_formulas("so $x_1 = \\text{you worthless fool}$ holds")
    sym, sentence, owner = abuse.letters(["```\nyou fool\n```"])
    assert len(sym) and set(owner.tolist()) == {0}
    sym, sentence, owner = abuse.letters(["a" * 200, "b" * 90, ""])
    assert np.bincount(sentence).max() == abuse.LONGEST and len(np.unique(sentence[owner == 0])) == 4 and len(np.unique(sentence[owner == 1])) == 1


def test_p8_rates_follow_from_scores(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test data not there")
    scores = {r["doc_id"]: r["score"] for r in abuse.p8_scores(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()
    assert len(docs) == len(scores)
    found = {r["doc_id"] for r in abuse.p8_found(spark, DATA).collect()}
    assert found == {k for k, v in scores.items() if v > 0}
    for r in abuse.p8_rates(spark, DATA).collect():
        own = [d["doc_id"] for d in docs if d["source"] == r["source"]]
        assert (r["documents"], r["flagged"]) == (len(own), len(found & set(own)))


def test_p3_report_follows_from_pairs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test data not there")
    found = {x for r in overlap.p3_found(spark, DATA).collect() for x in r}
    rows = {r["sample_id"]: (r["split"].strip().lower(), r["source"]) for r in spark.read.parquet(f"{DATA}/split_rows.parquet").where("split IS NOT NULL").collect()}
    for r in overlap.p3_report(spark, DATA).collect():
        own = {k for k, v in rows.items() if v == (r["split"], r["source"])}
        assert (r["samples"], r["overlapping"]) == (len(own), len(own & found)) and r["exact_overlapping"] <= r["overlapping"]


def test_p8_learns_from_labels(spark, tmp_path):
    r = random.Random(4)
    topics = ["graphs", "sets", "primes", "trees", "lattices"]
    docs, labels = [], []
    for i in range(160):
        t = ". ".join(f"The {r.choice(topics)} of step {r.randint(1, 99)} satisfy the bound" for _ in range(4)) + "."
        if i % 4 == 0:
            t += f" Nobody wants you blorping grumbles near the {r.choice(topics)}, you spleen."
            labels.append({"doc_id": i, "label": 1})
        elif i % 4 == 1:
            labels.append({"doc_id": i, "label": 0})
        docs.append({"doc_id": i, "text": t, "source": "a" if i % 8 else "b"})
    docs[2]["text"] += " Nobody wants you blorping grumbles near the sets, you spleen."
    d = make(spark, tmp_path, documents=docs, doc_labels=labels)
    got = {x["doc_id"] for x in abuse.p8_found(spark, d).collect()}
    assert got == {i for i in range(0, 160, 4)} | {2}
    rates = {x["source"]: (x["documents"], x["flagged"]) for x in abuse.p8_rates(spark, d).collect()}
    assert rates == {"a": (140, 21), "b": (20, 20)}


def test_normalisation_and_hashes():
    a = pa.array(["Ab-1。中", None, "ab1中", ""])
    cp, off = joined_letters(a)
    assert strings(cp, off).to_pylist() == ["ab1中", "", "ab1中", ""]
    h = text_hashes(cp, off)
    assert h[0] == h[2] and h[1] == h[3] != h[0]
    assert re.fullmatch(r"\w+", strings(cp, off)[0].as_py())


def spaced_edits(seed, n, length, first, step):
    """Pairs of random texts and versions with single letters replaced at even distances; all reach 0.6."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        u = list(t)
        for i in range(first, length - first, step):
            u[i] = r.choice("0123456789")
        out += [t, "".join(u)]
    assert all(jaccards(out[i : i + 2])[0, 1] >= 0.6 for i in range(0, 2 * n, 2))
    return out


def test_p1_leaves_no_pair_at_the_threshold_out(spark):
    texts = spaced_edits(5, 400, 200, 6, 12)
    assert p1_links(spark, texts) == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_p3_leaves_no_pair_at_the_threshold_out(spark, tmp_path):
    texts = spaced_edits(6, 400, 45, 9, 11)
    rows = [{"sample_id": i, "split": ["train", "test"][i % 2], "source": "s", "question": t} for i, t in enumerate(texts)]
    got = {(x["sample_id_a"], x["sample_id_b"]) for x in overlap.p3_found(spark, make(spark, tmp_path, split_rows=rows)).collect()}
    assert got == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_complete_blocks_are_written_few_times(spark, monkeypatch):
    from lectern.llm import complete

    monkeypatch.setattr(complete, "BLOCK", (40, 250_000))
    rng = np.random.default_rng(3)
    count = rng.integers(60, 120, 1600)
    rows = spark.createDataFrame(pd.DataFrame({"cls": np.arange(1600), "held": False, "count": count, "other": count // 2, "sketch": [bytes(16)] * 1600}), "cls long, held boolean, count int, other int, sketch binary")
    to, met = complete.met_blocks(rows, 0.6)
    told = to.select("cls", "block", "x", "y").toPandas()
    assert told["cls"].nunique() == 1600 and (told.groupby("cls")["block"].nunique() == 1).all()
    assert len(told) <= 8 * 1600 and met <= 28  # each text went to 16 pairs of blocks and more


def test_complete_part_of_a_sketch_drops_no_pair():
    from lectern.llm import complete

    rng = np.random.default_rng(4)
    n = 900
    base = rng.integers(0, 2**32, (n, 260))
    texts = [base[i // 3, : 70 + 60 * (i // 3 % 4)].copy() for i in range(n)]
    for i, x in enumerate(texts):
        x[: len(x) * (i % 3) // 9] = base[i, : len(x) * (i % 3) // 9]
    count = np.array([len(x) for x in texts])
    sketch = []
    for x in texts:
        bits = int(np.clip(2 ** np.ceil(np.log2(2 * len(x))), complete.LEAST_BITS, complete.MOST_BITS))
        sketch.append(np.packbits(np.bincount(x % bits, minlength=bits).astype(np.uint8) & 1).tobytes())
    pdf = pd.DataFrame({"x": "a", "y": "a", "block": "a", "cls": np.arange(n), "held": False, "count": count, "other": count // 2, "sketch": sketch})
    got = complete.blocks_met(pdf, 0.6, False)
    sets = [set(x.tolist()) for x in texts]
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    found = list(zip(got["a"], got["b"]))
    assert len(near) > 250 and near <= set(found) and len(found) == len(set(found)) < 2 * len(near)


def test_complete_by_rare_trigrams_leaves_no_pair_out(spark, tmp_path, monkeypatch):
    from lectern.llm import complete

    monkeypatch.setattr(complete, "MANY", 100)
    monkeypatch.setattr(complete, "RARE_BLOCK", 400)  # several blocks of sizes
    letters = "abcdefghijklmnopqrstuvwxyzαβγδεζηθικλμνξοπρστυφχψωбвгджзийклмнпртфхцчшщъыьэюя"
    r, texts = random.Random(8), []
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(r.choice([20, 40, 70, 120, 200, 320])))
        cut = r.random()
        if cut < 0.4:  # a part of the text
            u = t[: int(len(t) * r.uniform(0.6, 1)) + 2]
        else:  # letters replaced at even distances
            u = list(t)
            for i in range(5, len(t) - 5, 12 if cut < 0.8 else 10):
                u[i] = r.choice("0123456789")
            u = "".join(u)
        texts += [t, u]
    sim = jaccards(texts)
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sim[i, j] >= 0.6 and texts[i] != texts[j]}
    assert len(near) > 300
    share = complete.frequencies(near_duplicates.normalised(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"]))
    key = complete.keys(*joined_letters(pa.array(texts[:900])))
    assert complete.frequent(key, 900, share).mean() < 0.3  # most texts are not compared with all others
    assert {p for p in p1_links(spark, texts) if texts[p[0]] != texts[p[1]]} == near
    rows = [{"sample_id": i, "split": ["train", "test"][i % 2], "source": "s", "question": t} for i, t in enumerate(texts)]
    got = {(x["sample_id_a"], x["sample_id_b"]) for x in overlap.p3_found(spark, make(spark, tmp_path, split_rows=rows)).collect()}
    assert {p for p in got if texts[p[0]] != texts[p[1]]} == {p for p in near if (p[0] + p[1]) % 2}


def test_p2_every_pair_trains(spark):
    rows = [(i, f"Why does step {i} of the proof hold?", f"It holds since bound {i} was shown before, and the sum is finite.") for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, question string, answer string")
    last = [r["row_id"] for r in df.orderBy(F.xxhash64(F.lit(7), "row_id")).collect()][60:]
    other = df.withColumn("answer", F.when(F.col("row_id").isin(last), "Quartz jackdaws vex my big sphinx of whimsy.").otherwise(F.col("answer")))
    # the pairs with the largest hashes took no part when the sample was smaller than the table
    one, two = (pair_defects.fitted(x, "row_id", "question", "answer", part=60) for x in (df, other))
    assert not np.array_equal(one.spoken, two.spoken) and not np.array_equal(one.weights, two.weights)


def test_p2_goes_on_from_a_first_model_with_every_pair_once():
    pairs = [(f"Why does step {i} of the proof hold?", f"It holds since bound {i} was shown before. The sum {i * 7} is finite, as every term is.") for i in range(60)]
    pairs[7] = ("为什么第三步的证明在这种情形下仍然成立？", pairs[7][1])  # no answer is in this question's script
    known = pair_defects.told_languages(*pair_defects.language_counts(pairs, [q for q, _ in pairs]))
    wide = (1 << pair_defects.BITS) + 1
    begin = [np.zeros((len(pair_defects.LABELS), wide)), np.full((len(pair_defects.LABELS), wide), 1e-4)]
    w = pair_defects.gone_on(pairs, known, begin)
    other = pair_defects.gone_on([*pairs[:-1], (pairs[-1][0], "Quartz jackdaws vex my big sphinx of whimsy, it says.")], known, begin)
    assert not begin[0].any() and np.isfinite(w).all() and not np.array_equal(w, other)
    for seed in range(20):
        qs, as_, ys = pair_defects.Maker(pairs, seed).once()
        assert len(pairs) * 0.9 < sum(y > 0 for y in ys) <= len(pairs)


def test_pairs_that_no_defect_is_made_of_train_all_the_same():
    pairs = [("Is it so?", "Yes")]
    known = pair_defects.told_languages(*pair_defects.language_counts(pairs, ["Is it so?"]))
    wide = (1 << pair_defects.BITS) + 1
    begin = [np.zeros((len(pair_defects.LABELS), wide)), np.full((len(pair_defects.LABELS), wide), 1e-4)]
    none = [seed for seed in range(20) if not pair_defects.Maker(pairs, seed).once()[2]]
    assert none
    for seed in none:
        w = pair_defects.gone_on(pairs, known, begin, seed=seed)
        assert w.shape == (wide, len(pair_defects.LABELS)) and np.isfinite(w).all() and w[:-1].any()


def test_p1_workers_hold_little_at_once():
    import tracemalloc

    class Caught:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    letter_table()
    run = near_duplicates.normalised(Caught(), ["question"])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i} " + "some words of a text " * 20 for i in range(8000)])], names=["question"])
    tracemalloc.start()
    try:
        rows = sum(len(x) for x in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # a task of two chained workers takes this twice, and an executor runs two tasks
    assert rows == 8000 and most < 30e6
