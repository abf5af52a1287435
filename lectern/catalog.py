"""Named queries over the test tables and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import external as X
from .functions import names as N
from .functions import prompts as Q
from .functions import text as T
from .functions import vectors as V
from .operators import curate as C
from .operators import runs as R
from .operators import similar as S
from .operators import splits as P
from .operators import training as M
from .plans import curation
from .sources import config, readers, sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the test tables as the reference's concepts, in both languages

BL = r"[\t-\r\x{1c}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BL}|{BL}$', '', 'g')"


QA = "qa AS (SELECT DISTINCT row_id, _file, line_no, type, question, answer FROM qa_pairs WHERE row_id IS NOT NULL)"
QV = f"""{QA}, qv AS (SELECT row_id, _file, line_no, {_strip("coalesce(type,'')")} AS type, {_strip('question')} AS question, {_strip('answer')} AS answer
FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL AND {_strip('question')} <> '' AND {_strip('answer')} <> '')"""
MSG = """msg AS (SELECT DISTINCT message_id, conv_id, turn, content, CASE WHEN r IN ('user','assistant','system') THEN r WHEN r IN ('bot','ai','model') THEN 'assistant' WHEN r = 'human' THEN 'user' ELSE 'other' END AS role
FROM (SELECT message_id, conv_id, turn, content, lower(trim(coalesce(role,''))) AS r FROM chat_messages WHERE message_id IS NOT NULL))"""
VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def qa(spark, sf_dir) -> DataFrame:
    return C.once(table(spark, sf_dir, "qa_pairs"), "row_id").drop("created_at")


def valid(spark, sf_dir) -> DataFrame:
    return C.valid(qa(spark, sf_dir))


def valid_lengths(spark, sf_dir) -> DataFrame:
    """(row_id, type, q, a): lengths of the valid pairs; texts are measured before repeated deliveries are dropped, so none is shuffled."""
    v = C.valid(table(spark, sf_dir, "qa_pairs"))
    return C.once(v.select("row_id", "type", F.length("question").alias("q"), F.length("answer").alias("a")), "row_id")


def messages(spark, sf_dir) -> DataFrame:
    return C.once(table(spark, sf_dir, "chat_messages"), "message_id")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def qa_vectors(spark, sf_dir) -> DataFrame:
    """Even vectors as questions, the next one as answer."""
    v = vectors(spark, sf_dir)
    q = v.where("vec_id % 2 = 0").select("vec_id", "label", F.col("embedding").alias("q"))
    a = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("a"))
    return q.join(a, "vec_id")


QAVEC = f"{VEC}, qav AS (SELECT q.vec_id, q.label, q.v AS q, a.v AS a FROM vec q JOIN vec a ON a.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0)"


# --- reading, validation, normalisation


@query(f"WITH {MSG}, n AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(content) OVER w AS answer FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, content AS question, answer FROM n WHERE role = 'user' AND nr = 'assistant' AND nt = turn + 1")
def chat_pairs(spark, sf_dir):
    return M.adjacent_pairs(messages(spark, sf_dir))


@query(f"WITH {QA} SELECT row_id, CASE WHEN question IS NULL THEN 'question is no text' WHEN {_strip('question')} = '' THEN 'question is blank' WHEN answer IS NULL THEN 'answer is no text' WHEN {_strip('answer')} = '' THEN 'answer is blank' ELSE 'ok' END AS reason FROM qa")
def validate_reasons(spark, sf_dir):
    return qa(spark, sf_dir).select("row_id", F.coalesce(C.reason(F.col("question"), F.col("answer")), F.lit("ok")).alias("reason"))


@query(f"WITH {QV} SELECT row_id, _file, line_no, type, question, answer FROM qv")
def valid_pairs(spark, sf_dir):
    return valid(spark, sf_dir).select("row_id", "_file", "line_no", "type", "question", "answer")


@query(f"WITH {QA} SELECT row_id, {_strip("coalesce(type,'')")} AS type, question IS NOT NULL AND answer IS NOT NULL AND {_strip("coalesce(question,'')")} <> '' AND {_strip("coalesce(answer,'')")} <> '' AS valid FROM qa")
def json_validate(spark, sf_dir):
    """Rows written as JSON lines and validated as such: only JSON strings count as text."""
    lines = qa(spark, sf_dir).select("row_id", F.to_json(F.struct("type", "question", "answer"), {"ignoreNullFields": "false"}).alias("line"))
    return readers.parsed(lines).select("row_id", F.coalesce("type", F.lit("")).alias("type"), F.col("reason").isNull().alias("valid"))


@query(f"WITH {QA}, l AS (SELECT _file, line_no, question IS NOT NULL AND answer IS NOT NULL AND {_strip("coalesce(question,'')")} <> '' AND {_strip("coalesce(answer,'')")} <> '' AS ok FROM qa) SELECT _file AS path, CAST(count(*) FILTER (ok) AS BIGINT) AS valid, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS skipped FROM l GROUP BY _file")
def json_skipped(spark, sf_dir):
    lines = qa(spark, sf_dir).select(F.col("_file").alias("path"), F.to_json(F.struct("type", "question", "answer"), {"ignoreNullFields": "false"}).alias("line"))
    return readers.skipped(readers.parsed(lines))


@query("SELECT doc_id, CASE WHEN file_name IS NULL THEN NULL ELSE split_part(regexp_replace(regexp_replace(file_name, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), ' ', 1) END AS chapter FROM documents")
def chapter_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.chapter_tag(F.col("file_name")).alias("chapter"))


@query(f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text,''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '{BL}$', '')) AS ls FROM documents),
l2 AS (SELECT doc_id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM l), n AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l2), s AS (SELECT *, sum(CASE WHEN starts_with(x, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM n)
SELECT doc_id, CAST(sec - 1 AS INTEGER) AS section_no, md5(string_agg(x, chr(10) ORDER BY i)) AS hash FROM s WHERE sec > 0 GROUP BY doc_id, sec""")
def h2_sections(spark, sf_dir):
    return readers.sections(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "section_no", F.md5("section").alias("hash"))


@query(f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text,''), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '{BL}$', '')) AS ls FROM documents),
k AS (SELECT doc_id, len(list_filter(ls, lambda x: starts_with(x, '## '))) AS k FROM l), t(type, total, whole) AS (VALUES ('定义解释类',100,100),('逻辑推理类',300,50),('定义关系类',200,100),('实际应用类',100,50))
SELECT doc_id, CAST(s AS INTEGER) AS section_no, type, CAST(floor(total / k) AS INTEGER) AS n FROM k, t, generate_series(0, k - 1) g(s) WHERE k > 0 UNION ALL SELECT doc_id, -1, type, whole FROM k, t WHERE k > 0""")
def quota_plan(spark, sf_dir):
    return P.quota_plan(readers.sections(table(spark, sf_dir, "documents"), "doc_id", "text").drop("section"), "doc_id")


@query(f"WITH {QA} SELECT row_id, regexp_replace(question, '{T.LATEX}', '', 'g') AS question FROM qa")
def latex_strip(spark, sf_dir):
    return qa(spark, sf_dir).select("row_id", T.latex_strip(F.col("question")).alias("question"))


_STOPS = ",".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"WITH {QA}, p AS (SELECT row_id, trim(regexp_replace(regexp_replace(question, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM qa) SELECT row_id, t AS squeezed, array_to_string(list_filter(string_split(t, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)), ' ') AS words FROM p")
def preprocess_words(spark, sf_dir):
    t = T.squeeze(T.kept_letters(F.col("question")))
    return qa(spark, sf_dir).select("row_id", t.alias("squeezed"), F.array_join(T.without_stops(T.tokens(t)), " ").alias("words"))


@query(f"WITH {QA}, p AS (SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(question, '{T.LATEX}', '', 'g'), '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM qa) SELECT row_id, array_to_string(list_filter(string_split(t, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)), ' ') AS words FROM p")
def preprocess_text(spark, sf_dir):
    return qa(spark, sf_dir).select("row_id", T.preprocess(F.col("question")).alias("words"))


@query(f"WITH {QA} SELECT row_id, md5(question || '|||' || answer) AS pair_hash, md5(question) || ':' || md5(answer) AS key_hash, CAST(length(question) AS INTEGER) AS q_len, CAST(greatest(length(question), length(answer)) AS INTEGER) AS pair_len FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL")
def content_hashes(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    return qa(spark, sf_dir).where("question IS NOT NULL AND answer IS NOT NULL").select("row_id", T.content_hash(q, a).alias("pair_hash"), F.concat_ws(":", F.md5(q), F.md5(a)).alias("key_hash"), F.length(q).alias("q_len"), F.greatest(F.length(q), F.length(a)).alias("pair_len"))


@query(f"WITH {QV} SELECT md5(question || '|||' || answer) AS hash, min(row_id) AS first_id, count(*) AS copies FROM qv GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return C.exact_duplicates(valid(spark, sf_dir), "row_id", T.content_hash(F.col("question"), F.col("answer")))


# --- filters and thresholds


@query(f"WITH {QV} SELECT row_id, CAST(length(question) AS INTEGER) AS q, CAST(length(answer) AS INTEGER) AS a FROM qv WHERE greatest(length(question), length(answer)) <= 400 AND length(question) <= 300 AND length(answer) <= 350")
def length_filter(spark, sf_dir):
    return C.length_filter(valid(spark, sf_dir), pair=400, question=300, answer=350).select("row_id", F.length("question").alias("q"), F.length("answer").alias("a"))


@query(f"WITH {QV}, t AS (SELECT type, max(qa_lower) AS lo, max(qq_upper) AS up FROM type_thresholds GROUP BY type) SELECT row_id, qv.type, coalesce(lo, 0.5) AS qa_lower, coalesce(up, 0.85) AS qq_upper FROM qv LEFT JOIN t ON qv.type = t.type")
def thresholds(spark, sf_dir):
    return C.with_thresholds(valid(spark, sf_dir), table(spark, sf_dir, "type_thresholds")).select("row_id", "type", "qa_lower", "qq_upper")


@query(f"WITH {QAVEC} SELECT vec_id, label, round({COS.format(a='q', b='a')}, 6) AS qa_sim FROM qav")
def cosine_qa(spark, sf_dir):
    return qa_vectors(spark, sf_dir).select("vec_id", "label", F.round(V.cosine(F.col("q"), F.col("a")), 6).alias("qa_sim"))


@query(f"WITH {QAVEC}, s AS (SELECT vec_id, label, {COS.format(a='q', b='a')} AS sim FROM qav) SELECT vec_id, round(sim, 6) AS qa_sim FROM s WHERE sim >= CASE WHEN label % 2 = 0 THEN 0.05 ELSE -0.02 END")
def relevance_filter(spark, sf_dir):
    rows = qa_vectors(spark, sf_dir).withColumns({"qa_sim": V.cosine(F.col("q"), F.col("a")), "qa_lower": F.when(F.col("label") % 2 == 0, 0.05).otherwise(-0.02)})
    return C.relevant(rows).select("vec_id", F.round("qa_sim", 6).alias("qa_sim"))


# --- scores


@query(f"SELECT row_id, {_strip("regexp_replace(reply, '^((?s:.*?))<think>(?s:.*?)</think>', '" + chr(92) + "1')")} AS reply FROM qa_scores")
def strip_think(spark, sf_dir):
    return table(spark, sf_dir, "qa_scores").select("row_id", T.strip_think(F.col("reply")).alias("reply"))


_D = "translate(trim(regexp_replace(coalesce(reply,''), '^((?s).*?)<think>(?s).*?</think>', '\\1')), '０１２３４５６７８９', '0123456789')"
# RE2 has no Unicode word bounds: the last pattern is tried with explicit neighbours
_G = [f"regexp_extract(x, '{p}', 1)" for p in ('"score"\\s*:\\s*(\\d)', 'score["\\s:=]+\\s*(\\d)', "得分为?\\s*(\\d)", "评分[为:：]?\\s*(\\d)", "^(\\d)$", "(?:^|[^\\pL\\pN_\\pM])([0-5])(?:$|[^\\pL\\pN_\\pM])")]
_SCORE = "coalesce(" + ", ".join(f"CASE WHEN {g} BETWEEN '0' AND '5' AND length({g}) = 1 THEN CAST({g} AS INTEGER) END" for g in _G) + ")"


@query(f"WITH r AS (SELECT row_id, reply, {_D} AS x FROM qa_scores) SELECT row_id, reply, {_SCORE} AS score FROM r")
def extract_score(spark, sf_dir):
    return table(spark, sf_dir, "qa_scores").select("row_id", "reply", T.extract_score(F.col("reply")).alias("score"))


def _best_scores(spark, sf_dir):
    s = table(spark, sf_dir, "qa_scores").groupBy("row_id").agg(F.max("score").alias("score"))
    return qa(spark, sf_dir).join(s, "row_id", "left").select("row_id", "score")


_BS = f"{QA}, sc AS (SELECT row_id, max(score) AS score FROM qa_scores GROUP BY row_id), b AS (SELECT qa.row_id, sc.score FROM qa LEFT JOIN sc USING (row_id))"


@query(f"WITH {_BS} SELECT coalesce(score, 0) AS score, count(*) AS n FROM b GROUP BY 1")
def score_distribution(spark, sf_dir):
    return C.score_distribution(_best_scores(spark, sf_dir))


@query(f"WITH {_BS}, d AS (SELECT coalesce(score, 0) AS score, count(*) AS n FROM b GROUP BY 1) SELECT score, n, round(n / sum(n) OVER () * 100, 6) AS percentage, score >= 3 AS qualified FROM d")
def score_table(spark, sf_dir):
    return C.score_table(_best_scores(spark, sf_dir)).withColumn("percentage", F.round("percentage", 6))


@query(f"WITH {_BS} SELECT row_id, coalesce(score, 0) >= 3 AS kept FROM b")
def score_filter(spark, sf_dir):
    return C.score_split(_best_scores(spark, sf_dir), 3).select("row_id", "kept")


@query(f"WITH {_BS} SELECT count(*) AS total, count(*) FILTER (coalesce(score,0) >= 3) AS kept, count(*) FILTER (coalesce(score,0) < 3) AS removed FROM b")
def stage_counts(spark, sf_dir):
    return C.stage_counts(_best_scores(spark, sf_dir), F.coalesce("score", F.lit(0)) >= 3)


@query(f"WITH {QA}, r AS (SELECT row_id, arg_max(reply, struct_pack(a := scored_at, b := reply)) AS reply FROM qa_scores WHERE reply IS NOT NULL GROUP BY row_id), x0 AS (SELECT qa.row_id, question, answer, {_D} AS x FROM qa LEFT JOIN r USING (row_id)) SELECT row_id, CASE WHEN {_strip("coalesce(question,'')")} = '' OR {_strip("coalesce(answer,'')")} = '' THEN 0 ELSE coalesce({_SCORE}, 0) END AS score FROM x0")
def score_pipeline(spark, sf_dir):
    replies = table(spark, sf_dir, "qa_scores").where("reply IS NOT NULL")
    return curation.score_pipeline(qa(spark, sf_dir), replies, 3).select("row_id", "score")


# --- counts, histograms, summaries


@query(f"WITH {QV} SELECT type, count(*) AS n FROM qv GROUP BY type")
def type_counts(spark, sf_dir):
    return C.type_counts(valid(spark, sf_dir))


@query(f"WITH {QV}, d AS (SELECT printf('%02d', i) AS chapter FROM range(1, 11) t(i)), ty AS (SELECT DISTINCT type FROM qv WHERE type <> '') SELECT ty.type, d.chapter, count(qv.row_id) AS n FROM ty CROSS JOIN d LEFT JOIN qv ON qv.type = ty.type AND qv._file = d.chapter GROUP BY 1, 2")
def chapter_counts(spark, sf_dir):
    return C.chapter_counts(valid(spark, sf_dir))


@query(f"WITH {QV} SELECT DISTINCT type FROM qv WHERE type <> ''")
def distinct_types(spark, sf_dir):
    return C.distinct_types(valid(spark, sf_dir))


def _hist_sql(v: str, by: str | None, bins: int = 12) -> str:
    g = by or f"'{C.ALL}'"
    return f"""WITH {QV}, r AS (SELECT {g} AS g, {v} AS v FROM qv), c AS (SELECT least(max(v), {50 * bins}) AS cap FROM r), t AS (SELECT g, count(*) AS total FROM r GROUP BY g),
b AS (SELECT g, total, cap, i AS bin_no FROM t, c, generate_series(0, CAST(ceil(cap / 50.0) AS BIGINT) - 1) s(i)),
x AS (SELECT b.g, b.bin_no, (b.bin_no * 50) || ' ~ ' || (b.bin_no * 50 + 50) AS interval, count(r.v) AS n, b.total FROM b LEFT JOIN r ON r.g = b.g AND r.v >= b.bin_no * 50 AND r.v < b.bin_no * 50 + 50 AND r.v < b.cap GROUP BY 1, 2, 3, 5
UNION ALL SELECT r.g, CAST(ceil(cap / 50.0) AS BIGINT), '>= ' || cap, count(*), total FROM r, c, t WHERE t.g = r.g AND r.v >= cap GROUP BY r.g, cap, total)
SELECT g AS type, CAST(bin_no AS INTEGER) AS bin_no, interval, n AS count, round(n / total * 100, 6) AS percentage FROM x"""


def _hist(df, v, by):
    return C.length_histogram(df.withColumn("__v", v), "__v", by).withColumn("percentage", F.round("percentage", 6))


@query(_hist_sql("length(question)", "type"))
def len_hist_q(spark, sf_dir):
    return _hist(valid_lengths(spark, sf_dir), F.col("q"), "type")


@query(_hist_sql("length(answer)", "type"))
def len_hist_a(spark, sf_dir):
    return _hist(valid_lengths(spark, sf_dir), F.col("a"), "type")


@query(_hist_sql("greatest(length(question), length(answer))", None))
def len_hist_pair_all(spark, sf_dir):
    return _hist(valid_lengths(spark, sf_dir), F.greatest("q", "a"), None)


@query(f"WITH {QV} SELECT CASE WHEN grouping(type) = 1 THEN '{C.ALL}' ELSE type END AS type, CAST(max(length(question)) AS INTEGER) AS max_q, CAST(max(length(answer)) AS INTEGER) AS max_a, CAST(max(greatest(length(question), length(answer))) AS INTEGER) AS max_pair FROM qv GROUP BY ROLLUP (type)")
def len_max_rollup(spark, sf_dir):
    return C.largest_lengths(valid_lengths(spark, sf_dir), "q", "a")


@query(f"WITH h AS ({_hist_sql('length(question)', 'type')}) SELECT bin_no, interval, round(max(percentage) FILTER (type = '定义解释类'), 2) AS explain, round(max(percentage) FILTER (type = '逻辑推理类'), 2) AS infer FROM h GROUP BY bin_no, interval")
def len_hist_pivot(spark, sf_dir):
    h = C.length_histogram(valid_lengths(spark, sf_dir), "q", "type")
    h = h.withColumn("percentage", F.round("percentage", 6))
    return C.wide(h, "type", ["定义解释类", "逻辑推理类"]).withColumnsRenamed({"定义解释类": "explain", "逻辑推理类": "infer"})


@query(f"WITH {QAVEC}, s AS (SELECT label, {COS.format(a='q', b='a')} AS v FROM qav), b AS (SELECT i AS bin_no, round(i * 0.05, 2) AS lo, round((i + 1) * 0.05, 2) AS hi FROM range(20) t(i)), t AS (SELECT label, count(*) AS total FROM s GROUP BY label) SELECT t.label, CAST(b.bin_no AS INTEGER) AS bin_no, printf('%.2f ~ %.2f', lo, hi) AS interval, count(s.v) AS count, round(count(s.v) / total * 100, 6) AS percentage FROM t CROSS JOIN b LEFT JOIN s ON s.label = t.label AND s.v >= lo AND (s.v < hi OR (bin_no = 19 AND s.v <= hi)) GROUP BY 1, 2, 3, total")
def sim_hist_005(spark, sf_dir):
    rows = qa_vectors(spark, sf_dir).withColumn("sim", V.cosine(F.col("q"), F.col("a")))
    return C.similarity_histogram(rows, "sim", "label").withColumn("percentage", F.round("percentage", 6))


@query(f"WITH {QAVEC}, s AS (SELECT label, {COS.format(a='q', b='a')} AS v FROM qav) SELECT label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM s GROUP BY label")
def sim_summary(spark, sf_dir):
    rows = qa_vectors(spark, sf_dir).withColumn("sim", V.cosine(F.col("q"), F.col("a")))
    s = C.summary(rows, "sim", "label")
    return s.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


@query(f"WITH {QV}, f AS (SELECT * FROM qv WHERE greatest(length(question), length(answer)) <= 500), u AS (SELECT min(row_id) AS row_id FROM f GROUP BY md5(question || '|||' || answer)), st AS (SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n FROM (SELECT DISTINCT row_id FROM qa_pairs) UNION ALL SELECT 1, 'valid', count(*) FROM qv UNION ALL SELECT 2, 'length', count(*) FROM f UNION ALL SELECT 3, 'distinct', count(*) FROM u) SELECT stage_no, stage, n, round(n / coalesce(lag(n) OVER (ORDER BY stage_no), n) * 100, 6) AS retention, round(n / first_value(n) OVER (ORDER BY stage_no) * 100, 6) AS overall FROM st")
def stage_funnel(spark, sf_dir):
    t = table(spark, sf_dir, "qa_pairs")
    ok, (q, a) = C.reason(F.col("question"), F.col("answer")).isNull(), (T.strip(F.col(c)) for c in ("question", "answer"))
    rows = C.once(t.select("row_id", ok.alias("ok"), F.greatest(F.length(q), F.length(a)).alias("n"), T.content_hash(q, a).alias("hash")), "row_id")
    ok, short = F.col("ok"), F.col("ok") & (F.col("n") <= 500)
    return C.funnel(rows, [("raw", F.lit(True)), ("valid", ok), ("length", short)], distinct=("distinct", F.col("hash"))).withColumns({"retention": F.round("retention", 6), "overall": F.round("overall", 6)})


# --- similarity, de-duplication, sampling


_PAIRS = f"{VEC}, pr AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, {COS.format(a='a.v', b='b.v')} AS sim FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query(f"WITH {_PAIRS} SELECT label, i, j, round(sim, 6) AS sim FROM pr")
def qq_pairs(spark, sf_dir):
    return S.similar_pairs(vectors(spark, sf_dir), "vec_id", "label", "embedding").withColumn("sim", F.round("sim", 6))


@query(f"WITH {_PAIRS} SELECT label, round(avg(CASE WHEN sim > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS pairs FROM pr GROUP BY label")
def share_above(spark, sf_dir):
    return S.share_above(vectors(spark, sf_dir), "vec_id", "label", "embedding", 0.3).withColumn("share", F.round("share", 6))


def _greedy_sql(above: str) -> str:
    """CTEs after pr (label, i, j, sim): g (j) holds what a scan in order removes."""
    return f"""e AS (SELECT label, i, j FROM pr WHERE {above}), nb AS (SELECT label, j, list(i) AS nbrs, row_number() OVER (PARTITION BY label ORDER BY j) AS rn FROM e GROUP BY label, j),
f AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS rm FROM nb UNION ALL
SELECT nb.label, nb.rn, CASE WHEN len(list_filter(nb.nbrs, lambda x: NOT list_contains(f.rm, x))) > 0 THEN list_append(f.rm, nb.j) ELSE f.rm END FROM f JOIN nb ON nb.label = f.label AND nb.rn = f.rn + 1),
g AS (SELECT unnest(arg_max(rm, rn)) AS j FROM f GROUP BY label)"""


_GREEDY = f"{_PAIRS}, {_greedy_sql('sim > 0.25')}"


@query(f"WITH RECURSIVE {_GREEDY} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT j FROM g)")
def greedy_dedup(spark, sf_dir):
    kept, _ = S.greedy_dedup(vectors(spark, sf_dir), "vec_id", "label", "embedding", 0.25)
    return kept.select("vec_id", "label")


@query(f"WITH RECURSIVE {_GREEDY} SELECT pr.j, min(pr.i) AS i FROM pr JOIN g ON g.j = pr.j WHERE sim > 0.25 AND pr.i NOT IN (SELECT j FROM g) GROUP BY pr.j")
def dup_pairs(spark, sf_dir):
    _, pairs = S.greedy_dedup(vectors(spark, sf_dir), "vec_id", "label", "embedding", 0.25)
    return pairs.select("j", "i")


_UPPER, _LOWER = "CASE WHEN label % 2 = 0 THEN 0.25 ELSE 0.3 END", "CASE WHEN label % 3 = 0 THEN 0.02 ELSE -0.05 END"
_GQ = f"{QAVEC}, vec2 AS (SELECT vec_id, label, q AS v FROM qav), " + _PAIRS.replace(VEC + ", ", "").replace("FROM vec a JOIN vec b", "FROM vec2 a JOIN vec2 b") + ", " + _greedy_sql(f"sim > {_UPPER}")


@query(f"WITH RECURSIVE {_GQ} SELECT vec_id, round({COS.format(a='q', b='a')}, 6) AS qa_sim FROM qav WHERE vec_id NOT IN (SELECT j FROM g) AND {COS.format(a='q', b='a')} >= {_LOWER}")
def filter_pipeline(spark, sf_dir):
    rows = qa_vectors(spark, sf_dir).withColumns({"qq_upper": F.expr(_UPPER).cast("double"), "qa_lower": F.expr(_LOWER).cast("double")})
    out = curation.filter_pipeline(rows, "vec_id", "label", "q", "a", qq_upper="qq_upper", qa_lower="qa_lower")
    return out.select("vec_id", F.round("qa_sim", 6).alias("qa_sim"))


def _words_sql(x: str) -> str:
    """Preprocessed text."""
    t = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{T.LATEX}', '', 'g'), '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({t}, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)), ' ')"


def _signed_sql(x: str) -> str:
    """The offline embedder's counts, before they are scaled."""
    codes = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c))"
    return f"list_transform(range(0, 64), lambda k: coalesce(list_sum(list_transform(list_filter({codes}, lambda c: (c // 2) % 64 = k), lambda c: CASE WHEN c % 2 = 1 THEN -1.0 ELSE 1.0 END)), 0.0)::DOUBLE)"


_ZERO = "CASE WHEN list_dot_product({a}, {a}) < 1e-12 OR list_dot_product({b}, {b}) < 1e-12 THEN 0.0 ELSE " + COS + " END"
_TEXT = f"""{QV}, t AS (SELECT type, max(qa_lower) AS lo, max(qq_upper) AS up FROM type_thresholds GROUP BY type),
wd AS (SELECT row_id, qv.type AS label, {_words_sql('question')} AS qw, {_words_sql('answer')} AS aw, coalesce(lo, 0.5) AS lo, coalesce(up, 0.85) AS up FROM qv LEFT JOIN t ON qv.type = t.type WHERE qv.type <> '' AND greatest(length(question), length(answer)) <= 1000),
ve AS (SELECT row_id, label, lo, up, {_signed_sql('qw')} AS q, {_signed_sql('aw')} AS a FROM wd),
pr AS (SELECT x.label, x.row_id AS i, y.row_id AS j, x.up AS up, {_ZERO.format(a='x.q', b='y.q')} AS sim FROM ve x JOIN ve y ON x.label = y.label AND x.row_id < y.row_id), {_greedy_sql('sim > up')}"""


@query(f"WITH RECURSIVE {_TEXT} SELECT row_id, label AS type, round({_ZERO.format(a='q', b='a')}, 6) AS qa_sim FROM ve WHERE row_id NOT IN (SELECT j FROM g) AND {_ZERO.format(a='q', b='a')} >= lo")
def text_pipeline(spark, sf_dir):
    """Whole curation on the text columns with the offline embedder."""
    out = curation.text_pipeline(qa(spark, sf_dir), "row_id", X.apply(X.hashing_embedder(), "array<double>"), table(spark, sf_dir, "type_thresholds"))
    return out.select("row_id", "type", F.round("qa_sim", 6).alias("qa_sim"))


_DRAWN = """n AS (SELECT label, count(*) AS n, count(*) * (count(*) - 1) // 2 AS total FROM embeddings GROUP BY label),
d AS (SELECT label, p, md5('42|' || label || '|' || p) AS r FROM n, generate_series(1, total) s(p) WHERE total <= 100
UNION ALL SELECT label, CAST('0x' || substr(r, 1, 15) AS BIGINT) % total + 1 AS p, r FROM (SELECT label, total, md5('42|' || label || '|' || t) AS r FROM n, range(1, 171) s(t) WHERE total > 100)),
k AS (SELECT label, p, row_number() OVER (PARTITION BY label ORDER BY r, p) AS k FROM (SELECT label, p, min(r) AS r FROM d GROUP BY label, p)),
ij AS (SELECT label, p, CAST(ceil((1 + sqrt(1 + 8.0 * p)) / 2) AS BIGINT) AS j FROM k WHERE k <= 50), pair AS (SELECT label, CAST(p - (j - 1) * (j - 2) // 2 AS BIGINT) AS i, j FROM ij)"""


@query(f"WITH {_DRAWN} SELECT label, i, j FROM pair")
def pair_sample(spark, sf_dir):
    return S.sampled_pairs(vectors(spark, sf_dir), "vec_id", "label", 50, 42)


def _numbered(spark, sf_dir):
    """Rows numbered within their label; a label is one file of the reference, of bounded size."""
    return vectors(spark, sf_dir).withColumn("no", F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long"))


def _sampled(spark, sf_dir):
    v = _numbered(spark, sf_dir)
    pairs = S.sampled_pairs(v, "vec_id", "label", 50, 42)
    used = S.rows_used(v, pairs, "no", "label")
    a, b = used.select("label", F.col("no").alias("i"), F.col("embedding").alias("ea")), used.select("label", F.col("no").alias("j"), F.col("embedding").alias("eb"))
    return v, pairs.join(a, ["label", "i"]).join(b, ["label", "j"]).select("label", "i", "j", T.fixed8(V.cosine(F.col("ea"), F.col("eb"))).alias("cosine_similarity"))


_SAMPLED = f"{VEC}, {_DRAWN}, num AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS no FROM vec), sm AS (SELECT pair.label, i, j, printf('%.8f', {COS.format(a='a.v', b='b.v')}) AS cosine_similarity FROM pair JOIN num a ON a.label = pair.label AND a.no = i JOIN num b ON b.label = pair.label AND b.no = j)"


@query(f"WITH {_SAMPLED} SELECT label, i, j, cosine_similarity FROM sm")
def sampled_cosine(spark, sf_dir):
    return _sampled(spark, sf_dir)[1]


def _as_files(df):
    return df.select(F.lit("embeddings").alias("dataset"), F.col("label").cast("string").alias("file"), *[c for c in df.columns if c != "label"])


@query(f"WITH {_SAMPLED} SELECT 'embeddings' AS dataset, CAST(sm.label AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY sm.label ORDER BY i, j) AS INTEGER) AS sample_no, CAST(i AS BIGINT) AS line_no_a, CAST(j AS BIGINT) AS line_no_b, 't' || i % 3 AS type_a, 't' || j % 3 AS type_b, cosine_similarity, 'q' || a.vec_id AS question_a, 'q' || b.vec_id AS question_b FROM sm JOIN num a ON a.label = sm.label AND a.no = i JOIN num b ON b.label = sm.label AND b.no = j")
def sampled_details(spark, sf_dir):
    v, pairs = _sampled(spark, sf_dir)
    rows = v.select("label", "no", F.col("no").alias("line_no"), F.concat(F.lit("t"), F.col("no") % 3).alias("type"), F.concat(F.lit("q"), F.col("vec_id")).alias("question"))
    return sinks.detail_rows(_as_files(pairs), _as_files(rows), by=["dataset", "file"])


@query(f"WITH {_SAMPLED}, st AS (SELECT label, count(*) AS c, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS mx FROM (SELECT label, CAST(cosine_similarity AS DOUBLE) AS x FROM sm) GROUP BY label) SELECT 'embeddings' AS dataset, CAST(n.label AS VARCHAR) AS file, n.n AS valid_qa_count, CAST(0 AS BIGINT) AS skipped_line_count, coalesce(c, 0) AS sampled_pair_count, {', '.join(f"round(coalesce({x}, 0), 6) AS {y}" for x, y in (('mean', 'mean'), ('std', 'std'), ('mn', '"min"'), ('p25', 'p25'), ('p50', 'median'), ('p75', 'p75'), ('mx', '"max"')))} FROM n LEFT JOIN st ON st.label = n.label")
def sampled_summary(spark, sf_dir):
    v, pairs = _sampled(spark, sf_dir)
    counts = v.groupBy("label").agg(F.count("*").alias("valid"), F.lit(0).cast("long").alias("skipped"))
    out = sinks.summary_rows(_as_files(pairs), _as_files(counts), by=["dataset", "file"])
    return out.select(*sinks.SUMMARY[:5], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in sinks.SUMMARY[5:]])


@query(f"WITH {QA} SELECT row_id, CAST(42 + CAST('0x' || substr(md5(coalesce(_file, '')), 1, 8) AS BIGINT) AS BIGINT) AS seed FROM qa")
def file_seeds(spark, sf_dir):
    return qa(spark, sf_dir).select("row_id", T.stable_seed(42, F.coalesce("_file", F.lit(""))).alias("seed"))


# --- splits, schedules, expansion


_RANK = "row_number() OVER (ORDER BY md5('{seed}|' || row_id)) <= ceil((SELECT count(*) FROM {t}) * {p})"


@query(f"WITH {QA} SELECT row_id, CASE WHEN {_RANK.format(seed=42, t='qa', p=0.2)} THEN 'test' ELSE 'train_eval' END AS split FROM qa")
def fixed_split(spark, sf_dir):
    return P.test_split(C.once(table(spark, sf_dir, "qa_pairs").select("row_id"), "row_id"), "row_id", 0.2)


@query(f"WITH {QA}, s AS (SELECT row_id, {_RANK.format(seed=42, t='qa', p=0.2)} AS test FROM qa), pool AS (SELECT row_id FROM s WHERE NOT test) " + " UNION ALL ".join(f"SELECT row_id, {i} AS split_id, CASE WHEN {_RANK.format(seed=42 + i, t='pool', p=0.125)} THEN 'eval' ELSE 'train' END AS part FROM pool" for i in range(3)))
def epoch_resplit(spark, sf_dir):
    rows = C.once(table(spark, sf_dir, "qa_pairs").select("row_id"), "row_id")
    pool = P.test_split(rows, "row_id", 0.2).where("split = 'train_eval'").select("row_id")
    return P.resplits(pool, "row_id", 0.125, [0, 1, 2])


@query("SELECT CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, array_to_string(CASE WHEN k = 0 THEN [n] ELSE list_sort(list_distinct(list_concat(list_filter(range(1, n + 1), lambda e: e % k = 0), [n]))) END, ',') AS epochs FROM (SELECT k, n FROM range(0, 9) a(k), range(1, 13) b(n))")
def test_epochs(spark, sf_dir):
    g = spark.range(0, 9).select(F.col("id").cast("int").alias("k")).crossJoin(spark.range(1, 13).select(F.col("id").cast("int").alias("n")))
    return g.select("k", "n", F.array_join(P.test_epochs(F.col("k"), F.col("n")), ",").alias("epochs"))


@query(f"WITH {QV} SELECT row_id, CAST(c AS INTEGER) AS copy_no FROM qv, range(0, 3) t(c)")
def augment_expand(spark, sf_dir):
    return P.augmented(valid(spark, sf_dir), 3).select("row_id", "copy_no")


# --- chat and training rows


@query(f"WITH {MSG}, c AS (SELECT conv_id, turn, role, string_agg(role || ':' || md5(coalesce(content, '')), '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context FROM msg) SELECT conv_id, turn, md5(context) AS context FROM c WHERE role = 'user'")
def chat_context(spark, sf_dir):
    c = M.chat_contexts(messages(spark, sf_dir))
    return c.select("conv_id", "turn", F.md5(F.array_join(F.transform("context", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), "|")).alias("context"))


@query(f"WITH {MSG} SELECT m.conv_id, m.turn, md5(coalesce(string_agg('<|im_start|>' || s.role || chr(10) || coalesce(s.content, '') || '<|im_end|>', chr(10) ORDER BY s.turn) || chr(10), '') || '<|im_start|>user' || chr(10) || coalesce(any_value(m.content), '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM msg m LEFT JOIN msg s ON s.conv_id = m.conv_id AND s.turn <= m.turn AND s.role = 'system' WHERE m.role = 'user' GROUP BY m.conv_id, m.turn")
def chat_prompt(spark, sf_dir):
    c = M.chat_contexts(messages(spark, sf_dir), history=False)
    return c.select("conv_id", "turn", F.md5(T.chatml(F.col("context"))).alias("prompt"))


_PROMPT = "'<|im_start|>user' || chr(10) || CASE WHEN type <> '' THEN '问题类型：' || type || chr(10) || '问题：' || question ELSE question END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"WITH {QV} SELECT row_id, {_PROMPT} AS prompt, answer || '<|im_end|>' || '</s>' AS response FROM qv")
def sft_prompt(spark, sf_dir):
    return valid(spark, sf_dir).select("row_id", T.training_prompt(F.col("question"), F.col("type")).alias("prompt"), T.response(F.col("answer"), eos="</s>").alias("response"))


def _sft(spark, sf_dir):
    rows = valid(spark, sf_dir).select("row_id", T.training_prompt(F.col("question"), F.col("type")).alias("p"), T.response(F.col("answer")).alias("r"))
    return M.masked_rows(rows, M.token_codes(F.col("p")), M.token_codes(F.col("r")), 300)


_CODES = "list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c))"
_SFT = f"""{QV}, t AS (SELECT row_id, list_slice({_CODES.format(x="(" + _PROMPT + ")")}, 1, 300) AS p, {_CODES.format(x="(answer || '<|im_end|>')")} AS r FROM qv),
u AS (SELECT row_id, p, CASE WHEN len(p) >= 300 THEN [] ELSE list_slice(r, 1, 300 - len(p)) END AS r FROM t), f AS (SELECT row_id, list_concat(p, r) AS ids, list_concat(list_transform(p, lambda x: -100), r) AS labels FROM u)"""


@query(f"WITH {_SFT} SELECT row_id, md5(array_to_string(ids, ',')) AS input_ids, md5(array_to_string(labels, ',')) AS labels, CAST(len(ids) AS INTEGER) AS n FROM f")
def sft_rows(spark, sf_dir):
    j = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return _sft(spark, sf_dir).select("row_id", j("input_ids").alias("input_ids"), j("labels").alias("labels"), F.size("attention_mask").alias("n"))


@query(f"WITH {_SFT}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY row_id // 16) AS w FROM f) SELECT row_id, CAST(w AS INTEGER) AS width, CAST(len(ids) AS INTEGER) AS ones, CAST(list_sum(list_transform(labels, lambda x: CASE WHEN x = -100 THEN 1 ELSE 0 END)) + w - len(ids) AS INTEGER) AS ignored FROM w")
def pad_batch(spark, sf_dir):
    rows = M.padded(_sft(spark, sf_dir).withColumn("batch", F.floor(F.col("row_id") / 16)), "batch")
    return rows.select("row_id", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("ones"), F.size(F.filter("labels", lambda x: x == -100)).alias("ignored"))


@query(f"WITH {QV} SELECT row_id, CAST(count(*) OVER w AS INTEGER) AS earlier, md5(coalesce(string_agg(question, chr(10)) OVER w, '')) AS hash FROM qv WHERE _file IS NOT NULL WINDOW w AS (PARTITION BY _file, line_no // 300, type ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_questions(spark, sf_dir):
    """A section of a file, here 300 lines of it, and a type make one quota."""
    rows = valid(spark, sf_dir).where("_file IS NOT NULL").withColumn("section", F.floor(F.col("line_no") / 300))
    rows = M.earlier_questions(rows, ["_file", "section", "type"], "line_no", "question")
    return rows.select("row_id", F.size("earlier").alias("earlier"), F.md5(F.array_join("earlier", "\n")).alias("hash"))


# --- runs, checkpoints, parameters (literal fixtures)

# Directory names in several forms, stated alike in both dialects.
_DIR = """CASE p_partkey % 6
WHEN 0 THEN lpad(CAST(p_partkey AS STRING), 10, '0') || '_' || CAST(p_size % 9 + 1 AS STRING) || 'B_R-' || CAST(p_size AS STRING) || '_DR-0.' || CAST(p_partkey % 9 + 1 AS STRING) || '_top-' || CAST(p_size % 6 + 1 AS STRING) || '_qv_Run' || CAST(p_partkey AS STRING)
WHEN 1 THEN '2025' || lpad(CAST(p_partkey AS STRING), 10, '0') || '-0.' || CAST(p_size % 9 + 1 AS STRING) || 'B_R-' || CAST(p_size AS STRING) || '_AL-r-sqrta_full_qkvo'
WHEN 2 THEN 'LoRA_' || p_brand || '_end-' || CAST(p_size % 5 + 1 AS STRING)
WHEN 3 THEN lpad(CAST(p_partkey AS STRING), 10, '0') || '_4b_R-8_end-2_qkvo_Layer_Test'
WHEN 4 THEN p_brand || '_rank=' || CAST(p_size AS STRING) || '_dropout=0.' || CAST(p_size % 9 AS STRING) || '_scaling=r_a_vq_layers=input-3'
ELSE 'notes 2B ' || p_brand END"""


def _run_dirs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_DIR).alias("dir"), "p_size", "p_brand")


_RUNS = f"run AS (SELECT p_partkey AS id, {_DIR} AS dir, p_size, p_brand FROM part)"
_STAMP = "CASE WHEN regexp_matches(dir, '^\\d{4}\\d{4}[_-]?\\d{6}([_-]|$)') THEN substr(regexp_replace(regexp_extract(dir, '^(\\d{8}[_-]?\\d{6})', 1), '[_-]', '', 'g'), 5) WHEN regexp_matches(dir, '^\\d{10}([_-]|$)') THEN substr(dir, 1, 10) END"
_REST = "regexp_replace(dir, '^(\\d{8}[_-]?\\d{6}|\\d{10})([_-]+|$)', '')"
_SIZE = "upper(nullif(regexp_extract(replace({x}, '_', ' '), '(^|[^A-Za-z0-9.])(\\d+(\\.\\d+)?[Bb])($|[^A-Za-z0-9])', 2), ''))"


@query(f"WITH {_RUNS}, r AS (SELECT id, dir, {_STAMP} AS timestamp, {_REST} AS rest FROM run) SELECT id, timestamp, {_SIZE.format(x='rest')} AS size, CAST(nullif(regexp_extract(rest, '(^|_)R-(\\d+)', 2), '') AS INTEGER) AS rank, nullif(regexp_extract(rest, '(^|_)AL-([^_]+)', 2), '') AS scaling, CAST(nullif(regexp_extract(rest, '(^|_)DR-([0-9.]+)', 2), '') AS DOUBLE) AS dropout, nullif(regexp_extract(rest, '(^|_)(full|top-\\d+|end-\\d+)(_|$)', 2), '') AS layers, nullif(regexp_extract(rest, '(full|top-\\d+|end-\\d+)_([^_]+)', 2), '') AS modules, nullif(regexp_extract(rest, '(full|top-\\d+|end-\\d+)_[^_]+_(.+)$', 2), '') AS run_name FROM r")
def run_name_parse(spark, sf_dir):
    return _run_dirs(spark, sf_dir).select("id", N.parsed_run(F.col("dir")).alias("x")).select("id", "x.*")


def _settings(spark, sf_dir):
    """Run settings from parts: model, rank, scaling, dropout, side, count, modules."""
    k, n = F.col("p_partkey"), F.col("p_size")
    lists = [["self_attn.q_proj", "k_proj", "v_proj", "o_proj"], ["q_proj", "v_proj"], ["mlp.gate", "mlp.up proj", "x.gate"]]
    modules = F.when(k % 3 == 0, F.array(*map(F.lit, lists[0]))).when(k % 3 == 1, F.array(*map(F.lit, lists[1]))).otherwise(F.array(*map(F.lit, lists[2])))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("org/Model-"), (n % 9).cast("string"), F.lit(".5b")).alias("model"), n.cast("double").alias("rank"), F.when(k % 4 == 0, "r_sqrta").when(k % 4 == 1, " R/A ").alias("scaling"),
        (k % 8 / 16).cast("double").alias("dropout"), F.element_at(F.array(*[F.lit(x) for x in ("all", "input", "last", "", "Top")]), (k % 5 + 1).cast("int")).alias("side"), (n % 6 + 1).cast("int").alias("count"), modules.alias("modules"), "p_brand",
    )


def _core():
    return N.core_name(N.model_size(F.col("model")), F.col("rank"), F.col("scaling"), F.col("dropout"), N.layer_selection(F.col("side"), F.col("count")), N.module_code(F.col("modules")))


_CORE = """core AS (SELECT p_partkey AS id, p_brand, (p_size % 9) || '.5B_R-' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '_AL-r-sqrta' ELSE '' END || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE '_DR-' || format('{:g}', p_partkey % 8 / 16.0) END
|| CASE p_partkey % 5 WHEN 1 THEN '_top-' || (p_size % 6 + 1) WHEN 2 THEN '_end-' || (p_size % 6 + 1) WHEN 4 THEN '_top-' || (p_size % 6 + 1) ELSE '_full' END || CASE p_partkey % 3 WHEN 0 THEN '_qkvo' WHEN 1 THEN '_qv' ELSE '_gate-up-proj' END AS core FROM part)"""


@query(f"WITH {_CORE} SELECT id, core FROM core")
def run_name_build(spark, sf_dir):
    return _settings(spark, sf_dir).select("id", _core().alias("core"))


@query(f"WITH {_CORE} SELECT id, lpad(CAST(id AS VARCHAR), 10, '0') || '_' || core || CASE WHEN id % 2 = 0 THEN '_' || regexp_replace(p_brand, '[#\\s]+', '-', 'g') ELSE '' END AS dir FROM core")
def run_directory(spark, sf_dir):
    stamp = F.concat(F.lit("2025-"), F.lpad(F.col("id").cast("string"), 10, "0"))
    name = F.when(F.col("id") % 2 == 0, F.regexp_replace("p_brand", "#", " ")).otherwise(" ")
    return _settings(spark, sf_dir).select("id", N.directory_name(stamp, _core(), name).alias("dir"))


@query(f"WITH {_CORE}, d AS (SELECT id, core, CASE id % 4 WHEN 0 THEN lpad(CAST(id AS VARCHAR), 10, '0') || '_' || core || '_My_' || p_brand WHEN 1 THEN core WHEN 2 THEN 'LoRA_' || p_brand ELSE p_brand END AS dir, p_brand FROM core) SELECT id, CASE id % 4 WHEN 0 THEN 'My_' || p_brand WHEN 2 THEN p_brand END AS run_name, CASE WHEN id % 4 = 0 THEN lpad(CAST(id AS VARCHAR), 10, '0') ELSE '0102030405' END AS stamp FROM d")
def run_name_infer(spark, sf_dir):
    rows = _settings(spark, sf_dir).withColumn("core", _core())
    name = F.when(F.col("id") % 4 == 0, F.concat_ws("_", F.lpad(F.col("id").cast("string"), 10, "0"), "core", F.lit("My"), "p_brand")).when(F.col("id") % 4 == 1, F.col("core")).when(F.col("id") % 4 == 2, F.concat(F.lit("LoRA_"), "p_brand")).otherwise(F.col("p_brand"))
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    return rows.withColumn("dir", name).select("id", N.run_name(F.col("dir"), F.col("core")).alias("run_name"), N.run_timestamp(F.col("dir"), at).alias("stamp"))


@query(f"""WITH {_RUNS}, g AS (SELECT id, dir, lower(dir) AS low, coalesce(nullif(regexp_extract(dir, '(?i)(^|[_-])R[-_=]?(\\d+)($|[_-])', 2), ''), nullif(regexp_extract(dir, '(?i)(^|[_-])(lora_)?r(ank)?[=-](\\d+)($|[_-])', 4), '')) AS rk, nullif(regexp_extract(lower(dir), '(^|_)([qkvo]{{1,4}})($|_)', 2), '') AS code FROM run),
l AS (SELECT *, CASE WHEN regexp_matches(low, '(^|[_-])full($|[_-])') THEN 'full' ELSE coalesce(nullif(regexp_extract(low, '(^|[_-])(top[-_]?\\d+)($|[_-])', 2), ''), nullif(regexp_extract(low, '(^|[_-])(end[-_]?\\d+)($|[_-])', 2), ''), nullif(regexp_extract(low, 'layers[=_-](input[-_]?\\d+)($|[_-])', 1), '')) END AS lay FROM g)
SELECT id, {_SIZE.format(x='dir')} AS model, CAST(rk AS INTEGER) AS rank, regexp_replace(nullif(regexp_extract(dir, 'scaling[=-](r[/_-]a|r[/_-]sqrta)', 1), ''), '[_-]', '/') AS scaling, CAST(nullif(regexp_extract(dir, 'dropout(_rate)?[=-]([0-9.eE+-]+)($|[_-])', 2), '') AS DOUBLE) AS dropout,
CASE WHEN code IS NOT NULL THEN CASE WHEN contains(code, 'q') THEN 'q_proj ' ELSE '' END || CASE WHEN contains(code, 'k') THEN 'k_proj ' ELSE '' END || CASE WHEN contains(code, 'v') THEN 'v_proj ' ELSE '' END || CASE WHEN contains(code, 'o') THEN 'o_proj ' ELSE '' END END AS modules,
CASE WHEN lay IS NULL OR lay = 'full' THEN 'all' WHEN lay LIKE 'end%' THEN 'output' ELSE 'input' END AS side, CASE WHEN lay IS NULL OR lay = 'full' THEN 0 ELSE CAST(regexp_extract(lay, '\\d+') AS INTEGER) END AS "count" FROM l""")
def run_backfill(spark, sf_dir):
    none = F.lit(None).cast("string")
    x = N.filled_from_name(F.col("dir"), {"model": none, "rank": none, "scaling": none, "dropout": none, "modules": F.lit(None).cast("array<string>"), "side": none, "count": none})
    return _run_dirs(spark, sf_dir).select("id", x.alias("x")).select("id", "x.model", "x.rank", "x.scaling", "x.dropout", F.array_join(F.transform("x.modules", lambda m: F.concat(m, F.lit(" "))), "").alias("modules"), "x.side", "x.count")


def _modules(spark):
    rows = [(i * 3 + k, f"model.layers.{i}.self_attn.{m}") for i in range(6) for k, m in enumerate(("q_proj", "v_proj", "gate"))]
    return spark.createDataFrame(rows, "pos int, path string")


@query("SELECT 'model.layers.' || i AS layer, CAST(i + 1 AS INTEGER) AS layer_no, 'model.layers.' || i || '.self_attn.q_proj,model.layers.' || i || '.self_attn.v_proj' AS modules FROM range(4, 6) t(i)")
def module_layers_topn(spark, sf_dir):
    g = R.chosen_layers(R.layer_groups(_modules(spark), ["q_proj", "v_proj"]), "end", 2)
    return g.select("layer", "layer_no", F.array_join("modules", ",").alias("modules"))


@query("WITH m AS (SELECT 'layers.' || i || '.w' AS key FROM range(0, 8) t(i)), c AS (SELECT 'layers.' || i || '.w' AS key FROM range(3, 12) t(i)) SELECT coalesce(m.key, c.key) AS key, CASE WHEN m.key IS NOT NULL AND c.key IS NOT NULL THEN 'loaded' WHEN m.key IS NOT NULL THEN 'missing' ELSE 'unexpected' END AS state FROM m FULL JOIN c ON m.key = c.key")
def ckpt_key_match(spark, sf_dir):
    key = F.concat(F.lit("layers."), F.col("id").cast("string"), F.lit(".w")).alias("key")
    return R.matched_keys(spark.range(0, 8).select(key), spark.range(3, 12).select(key))


# Tensor keys of a model and of a checkpoint whose prefixes are mixed, from the nations' numbers.
_MKEY = "'model.layers.' || CAST(n_nationkey AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN '.self_attn.module.q_proj.weight' ELSE '.mlp.up.weight' END"
_CKEY = """CASE n_nationkey % 4 WHEN 0 THEN 'module.model.layers.' WHEN 1 THEN 'model.language_model.layers.' WHEN 2 THEN 'base_model.model.model.layers.' ELSE 'x.layers.' END || CAST(n_nationkey + n_regionkey % 2 AS STRING) || CASE WHEN (n_nationkey + n_regionkey) % 2 = 0 THEN '.self_attn.q_proj.weight' ELSE '.mlp.up.weight' END"""
_OPS = [(0, "identity", "", "", "")] + [x for i, p in enumerate(N.PREFIXES) for x in ((2 * i + 1, f"strip '{p}'", "cut", p, ""), (2 * i + 2, f"add '{p}'", "add", p, ""))] + [(9 + i, f"replace '{a}' with '{b}'", "cut", a, b) for i, (a, b) in enumerate(N.REPLACED)]
_Q = lambda x: "'" + str(x).replace("'", "''") + "'"
_WRAP = "CASE WHEN contains({k}, '.self_attn.') AND NOT contains({k}, '.self_attn.module.') AND NOT contains({k}, '.self_attn.adapter.') THEN regexp_replace({k}, '^(.*?)\\.self_attn\\.', '\\1.self_attn.module.') ELSE {k} END"
_UNWRAP = "regexp_replace({k}, '^(.*?)\\.self_attn\\.module\\.', '\\1.self_attn.')"
_KEYS = f"m AS (SELECT DISTINCT {_MKEY} AS key FROM nation), c AS (SELECT DISTINCT {_CKEY} AS key FROM nation)"
_TAILS = f"""tv AS (SELECT q, 0 AS way, q AS v FROM t UNION ALL SELECT q, 1, {_WRAP.format(k="q")} FROM t UNION ALL SELECT q, 2, {_UNWRAP.format(k="q")} FROM t),
ts AS (SELECT q, way, s, array_to_string(list_slice(string_split(v, '.'), s + 1, len(string_split(v, '.'))), '.') AS tail FROM tv, generate_series(0, len(string_split(v, '.')) - 1) g(s)),
hit AS (SELECT q, way, s, min(m.key) AS mk FROM ts JOIN m ON (s = 0 AND m.key = tail) OR (s > 0 AND ends_with(m.key, tail)) GROUP BY q, way, s HAVING count(*) = 1), suf AS (SELECT q, arg_min(mk, way * 1000 + s) AS mk FROM hit GROUP BY q)"""
_TRANSFORMED = f"""{_KEYS}, pf(i, name, kind, a, b) AS (VALUES {", ".join(f"({i}, {_Q(n)}, {_Q(k)}, {_Q(a)}, {_Q(b)})" for i, n, k, a, b in _OPS)}),
b AS (SELECT c.key, i, name, CASE WHEN kind = 'add' THEN a || c.key WHEN kind = 'cut' AND starts_with(c.key, a) THEN pf.b || substr(c.key, length(a) + 1) ELSE c.key END AS k FROM c, pf), t AS (SELECT DISTINCT k AS q FROM b), {_TAILS},
w AS (SELECT b.*, {_WRAP.format(k="k")} AS kw, {_UNWRAP.format(k="k")} AS ku, suf.mk FROM b LEFT JOIN suf ON q = k), mk AS (SELECT key AS k0 FROM m),
x AS (SELECT key, i, name, unnest([{{'j': 0, 'way': 'identity', 'n': k}}, {{'j': 1, 'way': 'insert adapter module wrapper', 'n': kw}}, {{'j': 2, 'way': 'remove adapter module wrapper', 'n': ku}}, {{'j': 3, 'way': 'prefer existing adapter module wrapper', 'n': CASE WHEN k IN (SELECT k0 FROM mk) THEN k WHEN kw IN (SELECT k0 FROM mk) THEN kw WHEN ku IN (SELECT k0 FROM mk) THEN ku ELSE k END}}, {{'j': 4, 'way': 'unique suffix match', 'n': coalesce(mk, k)}}]) AS r FROM w),
tf AS (SELECT CAST(i * 5 + r.j AS INTEGER) AS ord, CASE WHEN r.j = 0 THEN name WHEN i = 0 THEN r.way ELSE name || ' + ' || r.way END AS name, key, r.n AS new_key FROM x),
sc AS (SELECT ord, name, count(*) FILTER (new_key IN (SELECT k0 FROM mk)) AS matched FROM tf GROUP BY ord, name)"""


def _keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.expr(_MKEY).alias("key")), n.select(F.expr(_CKEY).alias("key"))


@query(f"WITH {_TRANSFORMED} SELECT ord, name, matched FROM sc")
def ckpt_transforms(spark, sf_dir):
    return R.transforms(*_keys(spark, sf_dir))


@query(f"WITH {_TRANSFORMED} SELECT name, matched FROM sc ORDER BY matched DESC, ord LIMIT 1")
def ckpt_best_transform(spark, sf_dir):
    return R.best_transform(*_keys(spark, sf_dir))


@query(f"""WITH {_TRANSFORMED}, u AS (SELECT key, new_key FROM tf WHERE name = 'unique suffix match'), z AS (SELECT DISTINCT 'loaded' AS state, new_key AS key FROM u WHERE new_key IN (SELECT k0 FROM mk) UNION ALL SELECT 'missing', k0 FROM mk WHERE k0 NOT IN (SELECT new_key FROM u) UNION ALL SELECT 'unexpected', key FROM u WHERE new_key NOT IN (SELECT k0 FROM mk)),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY key) AS r FROM z) SELECT state, count(*) AS keys, string_agg(key, ', ' ORDER BY key) FILTER (r <= 5) AS examples FROM r GROUP BY state""")
def ckpt_load_report(spark, sf_dir):
    return R.load_report(*_keys(spark, sf_dir), "unique suffix match")


@query(f"WITH {_KEYS}, t AS (SELECT key AS q FROM c), {_TAILS} SELECT q AS key, mk AS model_key FROM suf")
def ckpt_suffix_match(spark, sf_dir):
    model, keys = _keys(spark, sf_dir)
    return R.suffix_matches(keys, model)


@query("SELECT r_name AS folder, unnest(list_distinct(list('part-' || n_nationkey % 3 || '.bin'))) AS file FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def weight_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pair = F.struct("n_name", F.concat(F.lit("part-"), (F.col("n_nationkey") % 3).cast("string"), F.lit(".bin")))
    return R.weight_files(n.groupBy(F.col("r_name").alias("folder")).agg(F.map_from_entries(F.collect_list(pair)).alias("weight_map")))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN n_regionkey % 2 = 0 ELSE false END AS adapter FROM nation")
def adapter_checkpoints(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    log = F.when(k == 0, F.lit("a: 1\n active_method: Adapter_Finetuning \n")).when(k == 1, F.lit("active_method: lora"))
    folder = F.when(k == 2, F.lit("/runs/AdapterFinetuning/3")).when(k == 4, F.lit("/runs/prefix_1/lorem")).otherwise(F.concat(F.lit("/runs/"), "n_name"))
    keys = F.when(k == 3, F.array(F.when(F.col("n_regionkey") % 2 == 0, "l.adapter.gate").otherwise("l.weight")))
    return R.adapter_checkpoints(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), log.alias("log"), folder.alias("folder"), keys.alias("keys"))).select("id", "adapter")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey IN (0, 1) AND n_nationkey % 3 <> 0")
def incompatible_methods(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    method = F.element_at(F.array(*[F.lit(x) for x in (" Prefix_Tuning", "prefixft", "LoRA", "adapter", "other")]), F.col("n_regionkey").cast("int") + 1)
    config = F.when(F.col("n_nationkey") % 3 == 1, F.lit('{"layer_types": ["full_attention", "linear_attention"]}')).when(F.col("n_nationkey") % 3 == 2, F.lit('{"text_config": {"layer_types": ["linear_attention"]}}')).otherwise(F.lit('{"layer_types": ["full_attention"]}'))
    return R.incompatible(n.select(F.col("n_nationkey").alias("id"), method.alias("method"), config.alias("config"))).select("id")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN 'LoRA' WHEN 1 THEN 'PrefixFT' WHEN 2 THEN 'AdapterFinetuning' WHEN 3 THEN 'AdapterFinetuning' END AS exact, CASE n_nationkey % 6 WHEN 0 THEN 'LoRA' WHEN 1 THEN 'PrefixFT' WHEN 3 THEN 'AdapterFinetuning' WHEN 4 THEN 'LoRA' END AS mentioned FROM nation")
def method_names(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in (" LoRA ", "prefixtuning", "Llama_Adapter", "adapter_finetuning", "my-lora-2", "none")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), N.method(said).alias("exact"), N.method_in(said).alias("mentioned"))


_MET = "met AS (SELECT user_id AS run, event_id AS step, CAST(value AS DOUBLE) AS loss FROM events)"


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").cast("double").alias("loss"))


@query(f"WITH {_MET}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS k FROM met WHERE loss IS NOT NULL AND isfinite(loss)) SELECT run, step, loss FROM r WHERE k = 1")
def best_checkpoint(spark, sf_dir):
    return R.best_checkpoint(_metrics(spark, sf_dir), "run")


@query(f"WITH {_MET}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM met) SELECT run, step, best AS best_before, coalesce(loss < best, true) AS improved FROM b")
def running_best(spark, sf_dir):
    return R.running_best(_metrics(spark, sf_dir), "run").select("run", "step", "best_before", "improved")


@query(f"WITH {_MET}, e AS (SELECT *, step // 100 AS epoch FROM met), r AS (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY step) AS k FROM e) SELECT run, epoch, step FROM r WHERE k = 1")
def once_per_epoch(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("epoch", F.floor(F.col("step") / 100))
    return R.first_per_epoch(rows, ["run", "epoch"]).select("run", "epoch", "step")


@query(f"WITH {_MET}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM met) SELECT run, step FROM r WHERE k <= 3")
def retained_checkpoints(spark, sf_dir):
    return R.retained(_metrics(spark, sf_dir), "run", 3).select("run", "step")


@query("SELECT event_id, round(exp(value / 100.0), 6) AS perplexity, CAST(round_even(value, 0) AS INTEGER) AS epoch FROM events WHERE value < 1000")
def perplexity(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value < 1000")
    return e.select("event_id", F.round(T.perplexity(F.col("value") / 100.0), 6).alias("perplexity"), T.completed_epoch(F.col("value")).alias("epoch"))


@query("SELECT event_id AS step, 'train/value' AS tag, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL")
def scalar_series(spark, sf_dir):
    return sinks.scalar_series(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), "event_id", "train")


@query("SELECT 'r' || n_regionkey || '.' || n_name AS key_path, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey * 10 AS VARCHAR) ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation")
def config_override(spark, sf_dir):
    """Update-only: a change without a target adds no row."""
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_name"))
    new = n.where("n_nationkey % 3 = 0").select(path.alias("key_path"), (F.col("n_nationkey") * 10).cast("string").alias("value"))
    new = new.unionByName(n.select(F.concat(F.lit("none."), "n_name").alias("key_path"), F.lit("x").alias("value")))
    return config.overridden(n.select(path.alias("key_path"), F.col("n_nationkey").cast("string").alias("value")), new)


@query("SELECT CAST(r AS VARCHAR) AS rank, d AS dropout, '--rank=' || r || ' --dropout=' || d AS command FROM (VALUES (4),(8),(16)) a(r), (VALUES ('0.0'),('0.5')) b(d)")
def sweep_grid(spark, sf_dir):
    return R.sweep(spark, {"rank": [4, 8, 16], "dropout": [0.0, 0.5]})


@query("SELECT CAST(sum(p_size) FILTER (p_brand LIKE '%1') AS BIGINT) AS trainable, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def trainable_parameters(spark, sf_dir):
    return R.trainable(table(spark, sf_dir, "part").select(F.col("p_size").alias("n"), F.col("p_brand").endswith("1").alias("requires_grad")))


@query("WITH s AS (SELECT DISTINCT source AS target FROM documents WHERE source IS NOT NULL), d AS (SELECT doc_id AS old, source AS target, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL) SELECT old, CASE WHEN k = 1 THEN target ELSE target || '__dup' || (k - 1) END AS new FROM d")
def rename_plan(spark, sf_dir):
    return R.rename_plan(table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("old"), F.col("source").alias("target")))


@query(f"WITH {_RUNS} SELECT id, contains(lower(dir), 'lora') OR ({_SIZE.format(x='dir')} IS NOT NULL AND regexp_matches(dir, '(^|_)R-\\d+')) OR id % 7 = 0 AS lora FROM run")
def lora_runs(spark, sf_dir):
    log = F.when(F.col("id") % 7 == 0, F.lit("x: 1\nActive_Method: LoRA"))
    return _run_dirs(spark, sf_dir).select("id", N.is_lora_run(F.col("dir"), log).alias("lora"))


@query("SELECT user_id, arg_max(path, struct_pack(a := n, b := path)) AS path FROM (SELECT user_id, event_id AS n, 'run/checkpoint-' || event_id AS path FROM events) GROUP BY user_id")
def latest_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.latest(e.select("user_id", F.concat(F.lit("run/checkpoint-"), F.col("event_id").cast("string")).alias("path"), F.lit(0).alias("modified")), "user_id")


@query("SELECT '/r/a/' || i || '/x.bin' AS path, CASE WHEN i % 2 = 0 THEN '/r/a/' || i || '/c.yaml' ELSE '/r/c.yaml' END AS config FROM range(0, 6) t(i)")
def nearest_config(spark, sf_dir):
    at = lambda ids, end: ids.select(F.concat(F.lit("/r/a/"), F.col("id").cast("string"), F.lit(end)).alias("path"))
    configs = at(spark.range(0, 6, 2), "/c.yaml").unionByName(spark.createDataFrame([("/r/c.yaml",)], "path string"))
    return config.nearest_config(at(spark.range(6), "/x.bin"), configs)


@query("SELECT user_id AS path, arg_min(event_type, event_id) AS value FROM events GROUP BY user_id")
def first_logged(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("line_no"), F.concat(F.lit("kind: '"), F.col("event_type"), F.lit("'")).alias("line"))
    return readers.logged_values(lines, ["kind"]).select("path", "value")


@query("SELECT DISTINCT props AS raw, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(p.alias("raw"), F.try_variant_get(F.try_parse_json(p), "$.k", "int").alias("k")).distinct()


@query("SELECT source, md5(array_to_string(list_distinct_ordered, ',')) AS langs FROM (SELECT source, list(lang ORDER BY first) AS list_distinct_ordered FROM (SELECT source, lang, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang) GROUP BY source)")
def ordered_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    langs = F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"])
    return d.groupBy("source").agg(F.md5(F.array_join(langs, ",")).alias("langs"))


_G = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', {x}) END"


@query(f"SELECT l_orderkey, l_linenumber, {_G.format(x='sqrt(l_extendedprice)')} AS root, {_G.format(x='(sqrt(l_extendedprice) / 1000000000.0)')} AS small, {_G.format(x='(sqrt(l_extendedprice) * 100000.0)')} AS large, CAST(l_orderkey AS VARCHAR) AS whole FROM lineitem")
def number_format(spark, sf_dir):
    x = F.sqrt(F.col("l_extendedprice").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.number(x).alias("root"), N.number(x / 1e9).alias("small"), N.number(x * 1e5).alias("large"), N.number(F.col("l_orderkey")).alias("whole"))


@query("SELECT user_id, CAST(approx AS BIGINT) AS windows FROM (SELECT user_id, count(DISTINCT epoch(ts)::BIGINT // 3600) AS approx FROM events GROUP BY user_id)")
def event_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("windows"))


# --- seams with offline stand-ins


@query(f"WITH {QV} SELECT row_id, CASE WHEN length(question) < 2 THEN 0.0 ELSE 1.0 END AS norm FROM qv")
def seam_embedding(spark, sf_dir):
    rows = valid(spark, sf_dir).select("row_id", "question")
    return X.memoised(rows, "question", "v", X.apply(X.hashing_embedder(), "array<double>")).select("row_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(f"WITH {QV} SELECT row_id, least(5, length(answer) // 80) AS score FROM qv")
def seam_scoring(spark, sf_dir):
    rows = valid(spark, sf_dir)
    return rows.select("row_id", T.extract_score(X.apply(X.rule_scorer(), "string", tries=3)(F.col("answer"))).cast("long").alias("score"))


@query(f"WITH {QV} SELECT row_id, md5(array_to_string({_CODES.format(x='question')}, ',')) AS ids FROM qv")
def seam_tokenizer(spark, sf_dir):
    ids = X.apply(X.code_points(), "array<int>")(F.col("question"))
    return valid(spark, sf_dir).select("row_id", F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("ids"))


@query(f"""WITH {QV}, p AS (SELECT row_id, string_split(trim(regexp_replace(regexp_replace(question, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM qv),
c AS (SELECT row_id, flatten(list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '[\\x{{4e00}}-\\x{{9fff}}]+') THEN list_transform(range(1, greatest(length(w), 2)), lambda i: substr(w, i, 2)) ELSE [w] END)) AS ws FROM p)
SELECT row_id, array_to_string(list_filter(ws, lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w)), ' ') AS words FROM c""")
def seam_segmenter(spark, sf_dir):
    words = X.apply(X.ngram_segmenter(), "array<string>")(T.squeeze(T.kept_letters(F.col("question"))))
    return valid(spark, sf_dir).select("row_id", F.array_join(T.without_stops(words), " ").alias("words"))


@query(f"WITH {QV} SELECT row_id, '改写：' || substr(md5(question), 1, 8) AS question FROM qv")
def seam_paraphrase(spark, sf_dir):
    return valid(spark, sf_dir).select("row_id", X.apply(X.echo_generator("改写："), "string")(F.col("question")).alias("question"))


@query()
def seam_generation(spark, sf_dir):
    """Questions of a section and type one after another, each prompt holding the earlier ones."""
    asked = P.asked(readers.sections(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    return X.in_sequence(asked, ["doc_id", "section_no", "type"], "n", X.echo_generator("问："))


def _messages_sql(*turns: tuple[str, str]) -> str:
    """Messages as ChatML with the assistant's turn begun."""
    return " || chr(10) || ".join(f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>'" for role, text in turns) + " || chr(10) || '<|im_start|>assistant' || chr(10)"


def _filled_sql(template: str, **values: str) -> str:
    out = _Q(template)
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


_SCORING = _messages_sql(("system", _Q(Q.SCORE_SYSTEM)), ("user", _filled_sql(Q.SCORE_USER, question="question", answer="answer")))


@query(f"WITH {QV} SELECT row_id, md5({_SCORING}) AS prompt FROM qv")
def scoring_prompt(spark, sf_dir):
    return valid(spark, sf_dir).select("row_id", F.md5(T.chatml(Q.scoring(F.col("question"), F.col("answer")))).alias("prompt"))


@query(f"WITH {QV} SELECT row_id, least(5, least(length({_SCORING}), 4096) // 80) AS score FROM qv")
def seam_scoring_chat(spark, sf_dir):
    """Scores of whole scoring prompts by a model that sees 4,096 units of each, in batches with retries."""
    fn = X.apply(X.truncated(X.rule_scorer(), 4096), "string", tries=3)
    rows = X.answered(valid(spark, sf_dir), Q.scoring(F.col("question"), F.col("answer")), fn, "reply")
    return rows.select("row_id", T.extract_score(F.col("reply")).cast("long").alias("score"))


_ASKED = (("system", _Q(Q.WRITE_SYSTEM)), ("system", _filled_sql(Q.KIND_SYSTEM, kind="lang")), ("system", _filled_sql(Q.TEXT_SYSTEM, text="text")), ("system", _filled_sql(Q.EARLIER_SYSTEM, earlier="source")), ("user", _Q(Q.ASK_QUESTION)))


@query(f"SELECT doc_id, md5({_messages_sql(*_ASKED)}) AS asked, md5({_messages_sql(*_ASKED, ('assistant', 'file_name'), ('user', _Q(Q.ASK_ANSWER)))}) AS answered FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND file_name IS NOT NULL")
def generation_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND file_name IS NOT NULL")
    asked = Q.asking(F.col("lang"), F.col("text"), F.col("source"))
    return d.select("doc_id", F.md5(T.chatml(asked)).alias("asked"), F.md5(T.chatml(Q.answering(asked, F.col("file_name")))).alias("answered"))


_VARIED = (("system", _Q(Q.VARY_SYSTEM)), ("system", _filled_sql(Q.KIND_SYSTEM, kind="type")), ("system", _filled_sql(Q.PAIR_SYSTEM, question="question", answer="answer")), ("user", _Q(Q.ASK_QUESTION)), ("user", "CAST(c AS VARCHAR)"))


@query(f"""WITH {QV}, n AS (SELECT qv.*, c FROM qv, range(1, 3) t(c)), a AS (SELECT *, '问：' || substr(md5({_messages_sql(*_VARIED)}), 1, 8) AS nq FROM n)
SELECT row_id, CAST(0 AS INTEGER) AS copy_no, type, md5(question) AS q, md5(answer) AS a FROM qv UNION ALL SELECT row_id, CAST(c AS INTEGER), type, md5(nq), md5('答：' || substr(md5({_messages_sql(*_VARIED, ('assistant', 'nq'), ('user', _Q(Q.ASK_ANSWER)))}), 1, 8)) FROM a""")
def seam_augmentation(spark, sf_dir):
    rows = valid(spark, sf_dir).select("row_id", "type", "question", "answer")
    out = X.augmented_pairs(rows, 3, X.apply(X.echo_generator("问："), "string"), X.apply(X.echo_generator("答："), "string"))
    return out.select("row_id", "copy_no", "type", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query(f"WITH {MSG} SELECT m.conv_id, m.turn, '续：' || substr(md5(string_agg('<|im_start|>' || s.role || chr(10) || coalesce(s.content, '') || '<|im_end|>', chr(10) ORDER BY s.turn) FILTER (s.role <> 'other') || chr(10) || '<|im_start|>assistant' || chr(10)), 1, 8) AS reply FROM msg m JOIN msg s ON s.conv_id = m.conv_id AND s.turn <= m.turn WHERE m.role = 'user' GROUP BY m.conv_id, m.turn")
def seam_chat(spark, sf_dir):
    """The next turn of every conversation, each with its whole history."""
    c = M.chat_contexts(messages(spark, sf_dir))
    return X.answered(c, F.col("context"), X.apply(X.echo_generator("续："), "string"), "reply").select("conv_id", "turn", "reply")


@query("SELECT event_id, round(CAST(value AS DOUBLE) / 7, 6) AS loss, CAST(event_id AS DOUBLE) AS step FROM events WHERE value IS NOT NULL")
def rounded_metrics(spark, sf_dir):
    m = T.rounded_metrics(F.create_map(F.lit("loss"), F.col("value").cast("double") / 7, F.lit("step"), F.col("event_id").cast("double")))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", m.alias("m")).select("event_id", F.col("m.loss").alias("loss"), F.col("m.step").alias("step"))


@query(f"WITH {_BS}, d AS (SELECT coalesce(score, 0) AS score, count(*) AS n FROM b GROUP BY 1), p AS (SELECT score, n, n / sum(n) OVER () * 100 AS p FROM d) SELECT rpad(CAST(score AS VARCHAR), 12, ' ') || '  ' || lpad(CAST(n AS VARCHAR), 10, ' ') || '  ' || printf('%6.2f%%', p) || '  ' || repeat('█', CAST(floor(p / 2) AS BIGINT)) AS line FROM p")
def score_bars(spark, sf_dir):
    return sinks.bars(C.score_table(_best_scores(spark, sf_dir)), "score", "n", "percentage")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns paired, validated, cut to length, exact copies removed, counted by the first turn."""
    pairs = M.adjacent_pairs(messages(spark, sf_dir)).withColumn("type", F.lit("chat"))
    rows = C.length_filter(C.valid(pairs), pair=1000)
    once = rows.groupBy(T.content_hash(F.col("question"), F.col("answer")).alias("hash")).agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    n = once.groupBy(F.col("at.turn").alias("turn")).agg(F.count("*").alias("n"))
    return n.select("turn", "n", T.percent(F.col("n"), F.sum("n").over(W.partitionBy())).alias("percentage"))
