"""Text scalars as Spark SQL expressions; every one stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a strip removes, i.e. all Unicode white space and the four separators.
BLANKS = r"[\t-\r\x1c-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

#: Fixed value: the pattern meant to take bracketed LaTeX, braces escaped; a dot is any character but a line feed.
LATEX = r"\\[.*?\\]|\\\{.*?\\\}|\\(.*?\\)"

# The stop words of more than one character (single characters are dropped by length).
STOP_WORDS = [
    "一个", "没有", "自己", "什么", "怎么", "如何", "为什么", "哪个", "哪些", "何时", "何地",
    "对于", "关于", "根据", "按照", "通过", "经过", "由于", "因为", "所以", "因此", "于是", "然后",
    "接着", "此外", "另外", "同时", "以及", "及其", "或是", "还是", "或者",
    "不是", "就是", "而是", "但是", "然而", "虽然", "尽管", "即使", "如果",
    "假如", "假设", "比如", "例如", "譬如", "相比", "而言", "来说",
    "等等", "包括", "其中", "之间", "之内", "之外", "以后", "以前",
    "当前", "目前", "现在", "将来", "未来", "过去", "已经", "曾经", "刚刚",
    "正在", "将要", "可以", "能够", "应该", "必须", "需要", "可能", "也许",
    "大概", "大约", "左右", "前后", "上下", "多个", "一些", "一点", "有些",
    "许多", "很多", "大量", "少量", "这个", "那个", "这些", "那些", "每个",
    "任何", "所有", "全部", "一切", "有的", "某些",
]

# The ways a reply states a score, tried in this order.
SCORE_PATTERNS = [r'"score"\s*:\s*(\d)', r'score["\s:=]+\s*(\d)', r"得分为?\s*(\d)", r"评分[为:：]?\s*(\d)", r"^(\d)$", r"\b([0-5])\b"]


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def latex_strip(c: Column) -> Column:
    """Removes, on one line, everything from a backslash to the next bracket form as the reference pattern reads it."""
    return F.regexp_replace(c, "(?d)" + LATEX, "")


def kept_letters(c: Column) -> Column:
    """CJK ideographs, ASCII letters and digits; all else a blank."""
    return F.regexp_replace(c, "[^\\u4e00-\\u9fffA-Za-z0-9]", " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """The built-in segmenter: pieces between blanks. A word segmenter plugs in through :mod:`lectern.functions.external`."""
    return F.split(c, " ")


def without_stops(words: Column, stops: list[str] | None = None) -> Column:
    """Drops blanks, single characters and stop words."""
    listed = F.array(*[F.lit(w) for w in (STOP_WORDS if stops is None else stops)])
    return F.filter(words, lambda w: (F.length(F.trim(w)) > 1) & ~F.array_contains(listed, w))


def preprocess(c: Column) -> Column:
    """LaTeX removed, letters kept, blanks squeezed, tokens without stop words joined by blanks."""
    return F.array_join(without_stops(tokens(squeeze(kept_letters(latex_strip(c))))), " ")


def content_hash(question: Column, answer: Column) -> Column:
    return F.md5(F.concat_ws("|||", question, answer))


def strip_think(c: Column) -> Column:
    """Without the first reasoning block, then stripped."""
    return strip(F.regexp_replace(c, r"(?s)\A(.*?)<think>.*?</think>", "$1"))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def extract_score(c: Column) -> Column:
    """The first stated score of 0 to 5, by the patterns in order; null where there is none."""
    text = ascii_digits(strip_think(c))
    found = []
    for p in SCORE_PATTERNS:
        g = F.regexp_extract(text, "(?U)" + p, 1)
        found.append(F.when((g >= "0") & (g <= "5") & (F.length(g) == 1), g.cast("int")))
    return F.coalesce(*found)


def chapter_tag(name: Column) -> Column:
    """A file name without folder and extension, up to its first blank."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.substring_index(stem, " ", 1)


def interval_label(lo: Column, hi: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f ~ %.{decimals}f", lo, hi) if decimals else F.concat_ws(" ~ ", lo.cast("string"), hi.cast("string"))


def percent(part: Column, total: Column) -> Column:
    """Hundred times part over total, 0 for an empty total."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def fixed8(c: Column) -> Column:
    return F.format_string("%.8f", c)


def prompt(question: Column, kind: Column) -> Column:
    """The content of a training question: with a type line where the type is not empty."""
    # The two labels.
    q = strip(question)
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("问题类型："), strip(kind), F.lit("\n问题："), q)).otherwise(q)


def training_prompt(question: Column, kind: Column) -> Column:
    """The training prompt as a user turn that an assistant turn follows; without a chat template no system text is rendered."""
    return chatml(F.array(F.struct(F.lit("user").alias("role"), prompt(question, kind).alias("content"))), last_only=True)


def response(answer: Column, end: str = "<|im_end|>", eos: str = "") -> Column:
    r = F.concat(strip(answer), F.lit(end))
    return r if not eos else F.when(F.endswith(r, F.lit(eos)), r).otherwise(F.concat(r, F.lit(eos)))


def chatml(messages: Column, *, last_only: bool = False, generate: bool = True) -> Column:
    """Messages (array of role and content) in ChatML, other roles than the three left out; ``last_only`` renders the last message alone."""
    use = F.slice(messages, -1, 1) if last_only else F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    body = F.array_join(F.transform(use, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")
    return F.concat(body, F.lit("\n<|im_start|>assistant\n")) if generate else body


def stable_seed(seed: int, path: Column) -> Column:
    return (F.lit(seed) + F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long")).cast("long")


def hash_rank(seed: int, *key: Column) -> Column:
    """A reproducible random order: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def overfit_indicator(test: Column, train: Column) -> Column:
    return F.log10(test / F.nullif(train, F.lit(0.0)))


def rounded_metrics(metrics: Column) -> Column:
    """A map of metrics with values to six decimal places."""
    return F.transform_values(metrics, lambda _, v: F.round(v, 6))


def completed_epoch(epoch: Column) -> Column:
    """The nearest whole epoch, ties to even; null stays null."""
    return F.bround(epoch).cast("int")
