"""Problem 2: question-answer pairs whose answer does not answer, with the kind of defect.

A multi-label linear classifier on hashed n-grams and pair features, trained on the data itself: all pairs are taken as sound,
and from each pair defective ones are made (emptied, cut off, refused, copied, swapped with another pair's answer in the same
or another language). A first model finds defects among the presumed sound pairs; without them a second one is trained, and
thresholds are set on pairs kept out of training. A large table's pairs are dealt into parts by a hash of the id. The first
part trains a model in this way, all others go on from it with every pair once, beside it one defective pair made of it, and
their weights are averaged. Each pair is scored before it trains, which gives the part's thresholds.

Whether an answer is in the question's language is learned: answers to questions of one script give trigram frequencies, and
how likely an answer is under those of its question's script is a feature, as is the request to use another language.
All features come from array operations over the code points of a batch.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_letters, letter_table, mix64, once_fitted, pack_cells, read_table, slices, string_parts, text_hashes, unpack_cells, written
from .near_duplicates import trigrams

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
#: What the classifier learns besides; an answer to another question is no defect of p2_found.
LABELS = (*DEFECTS, "swapped")
#: Labels that are about question and answer together: they don't look at the answer's n-grams, which tell of the answer alone.
RELATIONS = ("copied", "other_language", "swapped")
BITS, LANGUAGE_BITS = 17, 16
#: Pairs that train one model (a table's models are averaged), steps of its training and rows a step.
PART, STEPS, BATCH = 3000, 560, 256
#: Named features lie below this id, n-grams from it on.
HALF = 1 << (BITS - 1)
#: Share of pairs with a given defect that is taken to be left among the cleaned sound pairs.
LEFT_OVER = 0.002

# What stands for an answer where there is none.
PLACEHOLDERS = ["", " ", "　", "\n", "…", "...", "。", ".", "-", "——", "--", "/", "？", "?", "略", "略。", "无", "暂无", "空", "（空）", "(empty)", "<empty>", "[]", "{}", "N/A", "n/a", "na", "nan", "NaN", "null", "NULL", "None", "none", "nil", "TODO", "TBD", "todo", "待补充", "待定", "未填写", "答：", "答案：", "Answer:", "A:", "```\n```", "***", "_", "$$", "​", "\t\n", "(blank)", "（无）", "待完善", "-", "\xa0"]
# Ways of declining, with a place for what was asked.
REFUSAL_PARTS = {
    "zh": (
        ["", "", "抱歉，", "对不起，", "不好意思，", "很遗憾，", "作为一个语言模型，", "谢谢你的提问，不过", "非常理解你的需求，但", "恕我直言，", "老实说，", "关于这道题，"],
        ["我无法回答这个关于{}的问题。", "我不能协助完成{}。", "我不便讨论{}的题目。", "暂时没有办法为{}提供答案。", "这类关于{}的请求我只能婉拒。", "涉及{}的内容，我拒绝提供解答。", "我没有能力判断{}。", "我没有足够的信息来处理{}，这次不作回答。", "讲义里没有{}的信息，我没法回答。", "目前帮不上忙，{}不在可讨论的范围内。", "这超出了我的能力范围，{}难以提供帮助。", "我选择不回应{}的求解请求。", "我不能给出{}的结论。", "{}这个问题我不予作答。", "请恕我不能继续讲解{}。", "我不愿意回答{}。", "我无法核实{}。", "我帮不了你处理{}。", "我不打算为{}提供解法。", "对{}我不发表意见。"],
        ["", "", "敬请谅解。", "请咨询授课教师。", "如有其他需要可以再告诉我。", "请换一个问题。", "请提供更多背景后再试。", "建议自行查阅{}一章。", "希望有人能帮到你。", "希望{}能找到合适的人。"],
    ),
    "en": (
        ["", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "As a language model, ", "To be honest, ", "Thanks for asking, but ", "I understand your request, yet ", "I apologise, ", "With regret, ", "Regarding this item, "],
        ["I cannot help with {}.", "I am unable to answer this question about {}.", "I can't assist with {}.", "I can't answer this question about {}.", "I must respectfully refuse to work on {}.", "I would rather not discuss {}.", "I decline to answer anything on {}.", "I do not have enough information to deal with {}.", "{} is beyond what I am able to discuss.", "this is beyond what I can assist with, {} included.", "I won't provide a solution for {}.", "I will not provide any answer to item {}.", "there is no way for me to give an answer about {}.", "requests about {} have to be turned down.", "I'm not able to comment on {}.", "I have no access to {} and so give no answer.", "it is not possible for me to respond to {}.", "it would not be right for me to solve {}.", "I would prefer not to comment on {}.", "I'd rather leave {} alone.", "answering anything on {} is something I must decline.", "I won't be giving a solution to {}.", "I am unable to check {}.", "I am unable to verify {} mentioned here.", "my apologies, {} is not something I can help with.", "no answer on {} can be had from me.", "I choose not to respond on {}."],
        ["", "", "I hope you understand.", "Please ask your lecturer.", "Feel free to ask something else.", "Please consult the chapter on {}.", "Consult {} instead.", "Let me know if you need anything else.", "Is there anything else I can do?", "Try again with more context.", "Try asking in terms of {}."],
    ),
}
# Frames around a repeated question.
COPY_FRAMES = ["{}", "{}", "{}", "答：{}", "题目是：{}", "问题：{}", "问：{}", "您问的是：{}", "关于“{}”", "Answer: {}", "Question: {}", "The question is: {}", "You asked: {}", "Q: {}", "> {}", "{}\n{}", "{}。", "{}.", "{}？", "题目如下：{}"]
# Beginnings of a statement, remark or block that nothing follows; {v} a letter, {n} a number.
BEGUN = {
    "zh": ["因此，", "所以", "综上所述，当", "接下来我们", "另外，由于", "其中", "并且", "例如，", "如果", "也就是说，", "然后再", "对于", "（例如 {v}", "（当 {v}", "（其中 {v}", "（假设 {v}"],
    "en": [" Therefore,", " Next we", " and since", " because", " which", " In other words, if", " such that the", " and then", " For", " (for instance {v}", " (assuming {v}", " (where {v}", " (that is {v}"],
    "": ["\n```python\nfor i in range({n}", "\n```\nif {v} > {n}", "\n```text\nstep {n}:", "\n| {v} | {n}", "\n- {v}", "\n{n}. "],
}
# Sentences in languages that few answers have.
SAMPLES = {
    "de": ["Nach Voraussetzung gilt die Aussage für jede Klasse, daher ist der Beweis damit abgeschlossen.", "Man zeigt zunächst, dass die Menge nicht leer ist, und wendet dann das Lemma auf den Rest an."],
    "fr": ["Par hypothèse on a une solution, donc il suffit de vérifier que la suite est bornée pour chaque terme.", "On montre que le graphe est connexe, car il reste une arête dans chaque partie."],
    "es": ["Por hipótesis se tiene una solución, y basta con ver que cada término es positivo para los demás casos.", "El recíproco es falso, pues para el segundo caso se obtiene una contradicción con lo anterior."],
    "ru": ["По условию утверждение верно для каждого класса, поэтому доказательство завершено.", "Обратное неверно, поскольку при этом получается противоречие с предыдущим шагом."],
    "ja": ["仮定より各クラスについて成り立つので、証明はこれで終わりである。", "逆は成り立たない。なぜなら反例が一つ得られるからである。"],
}
# Requests to answer in a language, by the language asked for.
REQUESTS = {"en": ["请用英文作答。", "答案请写英文。", "请用英语回答。", "Answer in English.", "（in English）"], "zh": ["Please reply in Chinese.", "Answer in Chinese please.", "Write the answer in Chinese.", "请用中文回答。", " (in Chinese)"], "de": ["Antworte auf Deutsch.", "请用德语作答。", "Please answer in German."], "fr": ["请用法语作答。", "Please answer in French."], "es": ["请用西班牙语作答。", "Please answer in Spanish."], "ru": ["请用俄语作答。", "Please answer in Russian."], "ja": ["请用日语作答。", "Please answer in Japanese."]}
FORMULA = re.compile(r"\$[^$\n]*\$?|```.*?(?:```|\Z)|`[^`\n]*`", re.S)
STOPS = "。！？!?.…；;"
# Kinds of characters: white space, line end, scripts, digit, marks.
OTHER, WHITE, LINE, HAN, KANA, CYRILLIC, LATIN, DIGIT, STOP, COMMA, OPEN, CLOSE, DOLLAR, TICK, BAR, LETTER = range(16)
_KINDS: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """The kind of every code point; built once per process."""
    if "k" not in _KINDS:
        import unicodedata

        out = np.zeros(0x110000, np.uint8)
        out[letter_table() > 0] = LETTER
        for i in range(0x3000):
            if unicodedata.category(chr(i)) in ("Zs", "Cc", "Cf"):
                out[i] = WHITE
            elif unicodedata.category(chr(i)) == "Nd":
                out[i] = DIGIT
        for a, b, k in ((0x4E00, 0xA000, HAN), (0x3400, 0x4DC0, HAN), (0x3041, 0x3100, KANA), (0x400, 0x530, CYRILLIC), (0x41, 0x5B, LATIN), (0x61, 0x7B, LATIN), (0xC0, 0x250, LATIN), (0xFF10, 0xFF1A, DIGIT)):
            out[a:b] = k
        for marks, k in (("\n\r", LINE), ("　", WHITE), (STOPS + "．", STOP), ("，,、", COMMA), ("（([{【《“‘「『", OPEN), ("）)]}】》”’」』", CLOSE), ("$＄", DOLLAR), ("`", TICK), ("|｜", BAR)):
            for c in marks:
                out[ord(c)] = k
        _KINDS["k"] = out
    return _KINDS["k"]


def _last(hit: np.ndarray, off: np.ndarray, none: int = -1) -> np.ndarray:
    """Per row the last place where ``hit`` holds, else ``none``."""
    at = np.flatnonzero(hit)
    i = np.searchsorted(at, off[1:]) - 1
    ok = i >= 0
    out = np.full(len(off) - 1, none, np.int64)
    out[ok] = at[i[ok]]
    return np.where(out >= off[:-1], out, none)


class Masked:
    """Texts as symbols: formulas and blocks as one each, digits as 0, white space squeezed, letters in lower case."""

    def __init__(self, column: pa.Array):
        cp, off = string_parts(column)
        cp = np.minimum(cp, 0x10FFFF)
        n, rows = len(cp), len(off) - 1
        kind = kinds()[cp]
        owner = np.repeat(np.arange(rows), np.diff(off))
        low = letter_table()[cp]
        first = np.zeros(n, bool)
        first[off[:-1][np.diff(off) > 0]] = True
        # formulas run to the next dollar or the end of the line, blocks to the next three ticks
        line_start = first.copy()
        line_start[1:] |= kind[:-1] == LINE
        dollar = kind == DOLLAR
        run = np.cumsum(dollar)
        base = np.maximum.accumulate(np.where(line_start, run - dollar, 0)) if n else run
        inside = (run - base) % 2 == 1
        tick = kind == TICK
        three = tick.copy()
        for d in (1, 2):
            three[d:] &= tick[:-d]
            three[:d] = False
        three[3:] &= ~tick[:-3]
        fences = np.cumsum(three)
        begun = np.maximum.accumulate(np.where(first, fences - three, 0)) if n else fences
        fence = (fences - begun) % 2 == 1
        drop = (inside & ~dollar) | (dollar & ~inside) | (fence & ~three) | (tick & ~three)
        kept = np.flatnonzero(~drop)
        k, own = kind[kept], owner[kept]
        same = np.r_[False, own[1:] == own[:-1]] if len(kept) else np.zeros(0, bool)
        before = np.r_[OTHER, k[:-1]] if len(kept) else k
        again = same & (((k == DIGIT) & (before == DIGIT)) | ((k == WHITE) & ((before == WHITE) | (before == LINE))) | ((k == LINE) & (before == LINE)))
        kept, k, own = kept[~again], k[~again], own[~again]
        sym = np.where(low[kept] > 0, low[kept], cp[kept]).astype(np.uint64)
        for which, c in ((DIGIT, 48), (WHITE, 32), (LINE, 10), (DOLLAR, 36), (TICK, 96)):
            sym[k == which] = c
        self.rows, self.kind, self.owner, self.sym = rows, k, own, sym
        self.off = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]).astype(np.int64)
        self.raw, self.raw_off = cp, off
        ends = np.maximum(off[1:] - 1, 0)
        filled = np.diff(off) > 0
        self.open_formula = np.where(filled, inside[ends], False) if n else np.zeros(rows, bool)
        self.open_block = np.where(filled, fence[ends] & ~three[ends], False) if n else np.zeros(rows, bool)
        self.letters = np.bincount(owner[low > 0], minlength=rows)

    def shares(self) -> np.ndarray:
        """Characters of Han, kana, Cyrillic and Latin script outside formulas, per row."""
        return np.stack([np.bincount(self.owner[self.kind == k], minlength=self.rows) for k in (HAN, KANA, CYRILLIC, LATIN)], axis=1)

    def grams(self, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of ``width`` symbols."""
        n = len(self.sym) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for d in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + self.sym[d : n + d] + np.uint64(1))
        inside = self.owner[:n] == self.owner[width - 1 :]
        return self.owner[:n][inside], h[inside]


def script(shares: np.ndarray) -> np.ndarray:
    """The script most of a text is in: 0 none, else 1 and the column; a Han character counts as three letters, twelve are needed, kana marks Japanese."""
    weight = shares * np.array([3, 3, 1, 1])
    weight[:, 1] = np.where(shares[:, 1] * 4 > shares[:, 0], shares[:, 1] * 100, 0)
    return np.where(weight.max(axis=1) >= 12, weight.argmax(axis=1) + 1, 0)


@dataclass
class Model:
    """Weights by feature and label with the offsets last; log frequencies of answers' trigrams by the question's script, and
    log odds of four-symbol runs in questions that ask for a language."""

    weights: np.ndarray
    spoken: np.ndarray

    def packed(self) -> tuple[bytes, bytes]:
        return pack_cells(self.weights.astype(np.float32)), pack_cells(self.spoken.astype(np.float32))

    @staticmethod
    def unpacked(packed: tuple[bytes, bytes]) -> Model:
        return Model(unpack_cells(packed[0], np.float32).reshape(-1, len(LABELS)), unpack_cells(packed[1], np.float32).reshape(ASKS + 1, -1))


#: Rows of the tables of language: trigrams of answers by the question's script, then runs of asking questions.
ASKS = 5


def languages(pairs: list[tuple[str, str]], asking: list[str]) -> np.ndarray:
    """What pairs tell of languages; ``asking`` holds the pairs' questions, each with a request to answer in some language."""
    return told_languages(*language_counts(pairs, asking))


def language_counts(pairs: list[tuple[str, str]], asking: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of answers by the question's script; runs of four in the questions and in the asking ones. Both add up over pairs."""
    slot = np.uint64(64 - LANGUAGE_BITS)
    q, a = Masked(pa.array([x for x, _ in pairs], pa.string())), Masked(pa.array([x for _, x in pairs], pa.string()))
    row, h = a.grams()
    at = script(q.shares())[row] << LANGUAGE_BITS | (h >> slot).astype(np.int64)
    runs = [np.bincount((x.grams(4)[1] >> slot).astype(np.int64), minlength=1 << LANGUAGE_BITS) for x in (q, Masked(pa.array(asking, pa.string())))]
    return np.bincount(at, minlength=ASKS << LANGUAGE_BITS).reshape(ASKS, -1), np.stack(runs)


def told_languages(counts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    told = np.log((counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * (1 << LANGUAGE_BITS)))
    return np.concatenate([told, np.log((runs[1] + 2.0) / (runs[0] + 2.0))[None]])


def features(questions: pa.Array, answers: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets, feature ids, values."""
    q, a = Masked(questions), Masked(answers)
    n = a.rows
    named: list[np.ndarray] = []
    weight: list[float] = []

    def add(*values: np.ndarray, scale: float = 0.5) -> None:
        weight.append(scale)
        h = np.full(n, len(named) + 1, np.uint64)
        for v in values:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(v).astype(np.int64).view(np.uint64) + np.uint64(7))
        named.append((mix64(h) >> np.uint64(65 - BITS)).astype(np.int64))

    # how the answer ends
    solid = (a.kind != WHITE) & (a.kind != LINE)
    end = _last(solid, a.off)
    some = end >= 0
    at = np.maximum(end, 0)
    kind = a.kind if len(a.kind) else np.zeros(1, np.uint8)
    sym = a.sym if len(a.sym) else np.zeros(1, np.uint64)
    tail = np.where(some, kind[at], 255)
    second = np.where(some & (at - 1 >= a.off[:-1]), kind[np.maximum(at - 1, 0)], 255)
    stop = (tail == STOP) | ((tail == CLOSE) & (second == STOP))
    before = np.arange(len(a.kind)) <= np.repeat(at, np.diff(a.off))
    line = np.where(_last((a.kind == LINE) & before, a.off) >= 0, _last((a.kind == LINE) & before, a.off) + 1, a.off[:-1])
    skip = np.minimum(line + (kind[np.minimum(line, len(kind) - 1)] == WHITE), len(kind) - 1)
    head, next_ = sym[skip], kind[np.minimum(skip + 1, len(kind) - 1)]
    style = np.where(kind[skip] == BAR, 1, np.where(kind[skip] == TICK, 2, np.where(np.isin(head, [45, 42, 0x2022]), 3, np.where((kind[skip] == DIGIT) & np.isin(next_, [STOP, CLOSE, COMMA]), 4, 0))))
    step = np.where(a.kind == OPEN, 1, np.where(a.kind == CLOSE, -1, 0))
    depth = np.cumsum(step)
    zero = np.r_[0, depth][a.off[:-1]]
    depth = depth - np.repeat(zero, np.diff(a.off))
    low = np.zeros(n, np.int64)
    filled = np.flatnonzero(np.diff(a.off) > 0)
    if len(filled):
        low[filled] = np.minimum(0, np.minimum.reduceat(depth, a.off[filled]))
    left = np.where(some, depth[np.minimum(at, max(0, len(depth) - 1))] if len(depth) else 0, 0) - low
    final = np.repeat(np.where(some, depth[np.minimum(at, max(0, len(depth) - 1))] if len(depth) else 0, 0), np.diff(a.off))
    opened = _last((a.kind == OPEN) & (depth == final), a.off)
    since_open = np.where((left > 0) & (opened >= 0), np.minimum(end - opened, 40), -1)
    since_stop = end - np.maximum(_last(((a.kind == STOP) | (a.kind == LINE)) & (np.arange(len(a.kind)) < np.repeat(at, np.diff(a.off))), a.off), a.off[:-1] - 1)
    since_comma = end - np.maximum(np.maximum(_last((a.kind == COMMA) & before, a.off), end - since_stop), a.off[:-1] - 1)
    cut = since_stop > 0
    add(stop, style)
    add(a.open_formula)
    add(a.open_block)
    add(np.minimum(left, 2), np.minimum(since_open, 13) // 3)
    add(stop, style, a.open_formula, a.open_block, since_open >= 0)
    add(tail, style)
    add(np.where(some, sym[at], 0), style)
    add(np.minimum(since_stop, 48) // 4, stop, style)
    add(np.minimum(since_comma, 30) // 3, stop, style)
    add(_last((a.kind == STOP) & (np.arange(len(a.kind)) < np.repeat(at, np.diff(a.off))), a.off) >= 0, stop, style)
    # lines before the last one: whether they end in a stop; a table's row against the row before
    ends = np.flatnonzero((a.kind == LINE) & before & (np.arange(len(a.kind)) > np.repeat(a.off[:-1], np.diff(a.off))))
    closed = np.isin(kind[np.maximum(ends - 1 - (kind[np.maximum(ends - 1, 0)] == WHITE), 0)], [STOP])
    total, good = np.bincount(a.owner[ends], minlength=n), np.bincount(a.owner[ends[closed]], minlength=n)
    mood = np.where(total == 0, 0, np.where(good == 0, 1, np.where(good == total, 2, 3)))
    add(mood, stop, style)
    number = np.cumsum((a.kind == LINE) | np.r_[True, a.owner[1:] != a.owner[:-1]]) if len(a.kind) else np.zeros(0, np.int64)
    bars = np.bincount(number[a.kind == BAR], minlength=(number[-1] + 2) if len(number) else 2)
    mine = number[at] if len(number) else np.zeros(n, np.int64)
    add(style == 1, np.where(style == 1, bars[mine] == bars[np.maximum(mine - 1, 0)], False), tail == BAR, np.where(style == 1, np.minimum(total, 3), 0))
    for k in (1, 2, 3, 4, 5, 6, 8, 10, 13):  # the last symbols, and the first
        h, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for d in range(k):
            i = end - d
            h = mix64(h * np.uint64(31) + np.where(some & (i >= a.off[:-1]), sym[np.maximum(i, 0)], 0).astype(np.uint64) + np.uint64(k))
            j = a.off[:-1] + d
            g = mix64(g * np.uint64(37) + np.where(j < a.off[1:], sym[np.minimum(j, len(sym) - 1)], 0).astype(np.uint64) + np.uint64(k))
        add(h.view(np.int64))
        if k in (2, 4, 6, 8):
            add(g.view(np.int64))
    # what there is at all
    size = np.diff(a.off)
    long = np.where(a.letters < 10, a.letters, 10 + (2 * np.log2(np.maximum(a.letters, 1))).astype(np.int64))
    add(long)
    add(a.letters == 0)
    cp, off = joined_letters(answers)
    brief = a.letters <= 10
    add(brief, np.where(brief, text_hashes(cp, off), 0))
    add(brief, np.where(size <= 14, text_hashes(a.sym.astype(np.uint32), a.off), 0))
    # overlap with the question
    tq, ta = trigrams(*joined_letters(questions)), trigrams(cp, off)
    both = np.concatenate([tq, ta])
    both.sort()
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(44)).astype(np.int64), minlength=n) if len(both) else np.zeros(n, np.int64)
    nq, na = np.bincount((tq >> np.uint64(44)).astype(np.int64), minlength=n), np.bincount((ta >> np.uint64(44)).astype(np.int64), minlength=n)
    ca, cq, new = common * 10 // np.maximum(na, 1), common * 10 // np.maximum(nq, 1), (2 * np.log2(na - common + 1)).astype(np.int64)
    add(ca)
    add(cq)
    add(ca, cq)
    add(new)
    add(ca, np.minimum(new, 12))
    add(np.minimum(common, 24) // 2, np.minimum(long, 20))
    # languages
    sq, sa = q.shares(), a.shares()
    dq, da = script(sq), script(sa)
    row, h = a.grams()
    heard = np.bincount(row, minlength=n)
    likely = np.bincount(row, weights=known[dq[row], (h >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64)], minlength=n) / np.maximum(heard, 1)
    level = np.where(heard > 0, np.floor(likely * 3).astype(np.int64), 0)
    much = np.minimum(np.log2(heard + 1).astype(np.int64), 7)
    odd = known[dq[row], (h >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64)] < -10.5
    unheard = np.bincount(row[odd], minlength=n) * 20 // np.maximum(heard, 1)
    most = sa * 8 // np.maximum(sa.sum(axis=1, keepdims=True), 1)
    amount = np.minimum(np.log2(sa.sum(axis=1) + 1).astype(np.int64), 6)
    add(dq, da)
    add(dq, da, amount)
    add(dq, level, much)
    add(dq, level)
    add(dq, unheard, much > 4)
    add(dq, most[:, 0], most[:, 2], most[:, 3], amount > 3)
    rowq, hq = q.grams(4)
    asks = np.bincount(rowq, weights=known[ASKS, (hq >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64)], minlength=n)
    asks = np.clip(asks // 3, 0, 5).astype(np.int64)
    other = (dq != da) & (da > 0) & (dq > 0)
    add(other, asks, scale=1.0)
    add(dq, da, asks > 1, scale=1.0)
    add(dq, level, asks > 1, scale=1.0)
    add(dq, unheard, asks > 1, scale=1.0)
    add(dq, level, much, asks > 1, scale=1.0)
    ids = np.stack(named, axis=1)
    blocks = [(np.repeat(np.arange(n), ids.shape[1]), ids.reshape(-1), np.tile(weight, n))]

    def block(row: np.ndarray, h: np.ndarray, salt: int, least: int, scale: float) -> None:
        count = np.bincount(row, minlength=n)
        key = mix64(h + np.uint64(salt))
        blocks.append((row, HALF | (key >> np.uint64(65 - BITS)).astype(np.int64), scale / np.sqrt(np.maximum(count, least))[row]))

    block(row, h, 1, 12, 2.0)
    short = a.letters[row] <= 160
    block(row[short], h[short], 2, 12, 2.0)
    row5, h5 = a.grams(6)
    short = a.letters[row5] <= 160
    block(row5[short], h5[short], 3, 12, 2.0)
    # words of the question that bear on a very short answer
    bears = brief[rowq]
    block(rowq[bears], hq[bears], 4, 12, 2.0)
    row, idx, val = (np.concatenate(x) for x in zip(*blocks))
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), idx[order].astype(np.int32), val[order].astype(np.float32)


def scores(off: np.ndarray, idx: np.ndarray, val: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows by labels: the linear scores, offsets included. Weights of relations lie in named features only."""
    out = np.empty((len(off) - 1, weights.shape[1]))
    few = np.flatnonzero(idx < HALF)
    near = np.concatenate([[0], np.cumsum(idx < HALF)])[off]
    for k in range(weights.shape[1]):
        out[:, k] = weights[-1, k]
        begin, i, x = (near, idx[few], val[few]) if LABELS[k] in RELATIONS else (off, idx, val)
        filled = np.flatnonzero(np.diff(begin) > 0)
        if len(filled):
            out[filled, k] += np.add.reduceat(np.ascontiguousarray(weights[:-1, k])[i] * x, begin[:-1][filled])
    return out


def fit(off: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, *, steps: int = STEPS, rate: float = 0.15, decay: float = 1e-5, seed: int = 0, state: list[np.ndarray] | None = None) -> np.ndarray:
    """Logistic regression per label by Adagrad over shuffled batches, classes weighing alike; the last row holds the offsets.

    With ``state``, weights and sums of squares, it goes on from there with one pass and changes them; an empty one is filled.
    """
    n, size, further = len(off) - 1, np.diff(off), bool(state)
    rng, wide = np.random.default_rng(seed), (1 << BITS) + 1
    w, seen = state or (np.zeros((y.shape[1], wide)), np.full((y.shape[1], wide), 1e-4))
    share = np.maximum(1, y.sum(axis=0))
    balance = np.where(y > 0, 0.5 * n / share, 0.5 * n / np.maximum(1, n - share)) / BATCH
    balance = np.minimum(balance, 4.0 / BATCH)
    held, where = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    for _ in range(1 if further else -(-steps * BATCH // max(1, n))):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            count = size[rows]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[rows], count)
            own, ids, x = np.repeat(np.arange(len(rows)), count), idx[at], val[at]
            held[ids] = True
            used = np.flatnonzero(held)
            held[used] = False
            where[used] = np.arange(len(used))
            place = where[ids]
            # relations have weights in named features only, which come first
            named = np.flatnonzero(ids < HALF)
            sides = (own, used, place, x), (own[named], used[used < HALF], place[named], x[named])
            for k in range(y.shape[1]):
                row, mine_at, to, value = sides[LABELS[k] in RELATIONS]
                mine = w[k, mine_at]
                z = np.bincount(row, weights=mine[to] * value, minlength=len(rows)) + w[k, -1]
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows, k]) * balance[rows, k]
                g = np.bincount(to, weights=err[row] * value, minlength=len(mine_at)) + decay * mine
                total = seen[k, mine_at] + g * g
                seen[k, mine_at] = total
                w[k, mine_at] = mine - rate * g / np.sqrt(total)
                b = err.sum()
                seen[k, -1] += b * b
                w[k, -1] -= rate * b / np.sqrt(seen[k, -1])
    if state is not None:
        state[:] = w, seen
    return np.ascontiguousarray(w.T)


class Maker:
    """Defective pairs made from sound ones; the same seed gives the same pairs."""

    def __init__(self, pairs: list[tuple[str, str]], seed: int = 7):
        self.r, self.pairs = random.Random(seed), pairs

    @functools.cached_property
    def spoken_q(self) -> list[int]:
        return _scripts([q for q, _ in self.pairs])

    @functools.cached_property
    def by_script(self) -> dict[int, list[str]]:
        """Answers by their script."""
        out: dict[int, list[str]] = {}
        for (_, a), s in zip(self.pairs, _scripts([a for _, a in self.pairs])):
            out.setdefault(s, []).append(a)
        return out

    def noise(self, t: str) -> str:
        """Typing noise, which is no defect."""
        kind = self.r.random()
        if kind < 0.6 or not t:
            return t
        if kind < 0.7:
            return t.lower()
        if kind < 0.76:
            return t.replace(" ", "")
        if kind < 0.84:
            return t.translate(str.maketrans("，。？；：（）", ",.?;:()"))
        out = list(t)
        for _ in range(self.r.randint(1, 3)):
            i = self.r.randrange(len(out))
            out[i] = self.r.choice(["", out[i] * 2, out[i] + " "])
        return "".join(out)

    def topic(self, q: str) -> str:
        found = re.findall(r"\$[^$]+\$", q)
        if found and self.r.random() < 0.4:
            return self.r.choice(found)
        words = re.split(r"[，。；：、,.:;?？（）()]+", FORMULA.sub(" ", q))
        words = [w.strip() for w in words if len(w.strip()) > 1] or ["这道题"]
        w = self.r.choice(words)
        i = self.r.randrange(len(w))
        piece = w[i : i + self.r.randint(4, 30)].strip() if len(w) > 12 else w
        return piece or w

    def empty(self, q: str, a: str, s: int) -> str:
        return self.r.choice(PLACEHOLDERS)

    def truncated(self, q: str, a: str, s: int) -> str | None:
        t = a.rstrip()
        if self.r.random() < 0.45:
            lang = "" if self.r.random() < 0.25 else "zh" if HAN - 2 == s else "en"
            begun = self.r.choice(BEGUN[lang]).replace("{v}", self.r.choice("abcdhkmnpqrtxyz")).replace("{n}", str(self.r.randint(2, 999)))
            if begun[0] in "（ (" and ("（" in begun or "(" in begun):
                t = t.rstrip("。.")
            return t + begun
        # what stands open at a cut: a place inside a sentence, item, formula or block
        for _ in range(6):
            if len(t) < 12:
                return None
            i = self.r.randint(max(4, len(t) // 6), len(t) - 3)
            head, rest = t[:i].rstrip(), t[i:]
            if not head or head[-1] in STOPS + "\n|" or head.endswith("```") or re.match(r"\s*([。！？\n]|\.(\s|$))", rest):
                continue
            return head
        return None

    def refusal(self, q: str, a: str, s: int) -> str:
        lead, core, end = REFUSAL_PARTS["zh" if s == 1 else "en"]
        first, second = self.r.choice(lead), self.r.choice(core).replace("{}", self.topic(q))
        if s != 1 and not first:
            second = second[:1].upper() + second[1:]
        return (first + second + " " * (s != 1) + self.r.choice(end).replace("{}", self.topic(q))).strip()

    def copied(self, q: str, a: str, s: int) -> str:
        t = self.noise(self.noise(q.strip()))
        if self.r.random() < 0.15:
            parts = [x for x in re.split(r"(?<=[，。？,.?])", t) if x.strip()]
            if len(parts) > 1:
                if self.r.random() < 0.5:
                    self.r.shuffle(parts)
                else:
                    parts = parts[: max(1, len(parts) - 1)]
                t = "".join(parts)
        return self.r.choice(COPY_FRAMES).replace("{}", t)

    def foreign(self, q: str, a: str, s: int) -> tuple[str, str] | None:
        """An answer in another language than the question's, and that language."""
        own = {1: "zh", 4: "en"}.get(s, "")
        langs = [x for x, k in (("zh", 1), ("en", 4)) if self.by_script.get(k) and x != own] + list(SAMPLES)
        lang = self.r.choice(langs[:1] * 5 + langs) if langs else None
        if lang is None:
            return None
        if lang in SAMPLES:
            # words in any order, so that the language is learned rather than the sentences
            joint, found = "" if lang == "ja" else " ", re.findall(r"\$[^$]+\$", a) or [""]
            words = [x for t in SAMPLES[lang] for x in (re.findall(r".{2,5}", t) if lang == "ja" else t.split())]
            return joint.join(self.r.choice(found) if self.r.random() < 0.12 else self.r.choice(words) for _ in range(self.r.randint(8, 50))), lang
        return self.r.choice(self.by_script[1 if lang == "zh" else 4]), lang

    def swapped(self, q: str, a: str, s: int) -> str | None:
        """The answer to another question, in the same language."""
        others = self.by_script.get(s, [])
        b = self.r.choice(others) if len(others) > 1 else a
        return b if b != a else None

    def asking(self, q: str, lang: str) -> str:
        """A question that asks for an answer in a language."""
        ask, where = self.r.choice(REQUESTS[lang]), self.r.random()
        if where < 0.6:
            return q.rstrip() + ask
        if where < 0.8:
            return ask + q
        cut = max(q.rfind("，"), q.rfind(", "), q.rfind("？"), 0)
        return q[: cut + 1] + ask.rstrip("。.") + q[cut:]

    def restated(self, q: str, a: str) -> tuple[str, str]:
        return q, self.r.choice(["题目问的是：{}{}", "问题：{}\n{}", "The question asks: {} {}", "{}\n\n{}", "{}{}", "{} {}"]).replace("{}", q, 1).replace("{}", a, 1)

    def sentences(self, a: str) -> list[str]:
        return [x.strip().rstrip("。.") for x in re.split(r"(?<=。)|(?<=\.)\s", a) if len(x.strip()) > 8 and "\n" not in x.strip()]

    def listed(self, q: str, a: str, s: int) -> str | None:
        """A complete list without final stops, from the answer's sentences."""
        if "\n" in a or "|" in a[:2]:
            return None
        parts = self.sentences(a)
        if not parts:
            return None
        parts = (parts + self.sentences(self.r.choice(self.by_script.get(s) or [a])))[: self.r.randint(1, 5)]
        self.r.shuffle(parts)
        numbered = self.r.random() < 0.3
        return "\n".join((f"{i + 1}. " if numbered else "- ") + x for i, x in enumerate(parts))

    def concluded(self, a: str, s: int) -> str | None:
        """A complete answer that ends in a formula without a stop."""
        found = re.findall(r"\$[^$\n]+\$", a)
        return a.rstrip() + (self.r.choice(["综上 ", "综上，", "所以 ", "故 ", ""]) if s == 1 else self.r.choice([" In short, ", " Hence ", " So ", " "])) + self.r.choice(found) if found else None

    def blocked(self, a: str) -> str | None:
        """A complete table or block of formulas, which is in no language."""
        found = re.findall(r"\$[^$\n]+\$", a)
        if not found:
            return None
        rows = [self.r.choice(found) for _ in range(self.r.randint(2, 5))]
        if self.r.random() < 0.5:
            return "\n".join([self.r.choice(["| i | value |", "| no | term |", "| k | f |"]), "|---|---|", *(f"| {i + 1} | {x} |" for i, x in enumerate(rows))])
        return "\n".join([self.r.choice(["```text", "```python", "```"]), *(f"{self.r.choice(['step', 'line', 'case'])} {i + 1}: {x}" for i, x in enumerate(rows)), "```"])

    def brief(self, q: str, s: int) -> tuple[str, str]:
        """A sound short answer that was asked for."""
        found = re.findall(r"\$[^$]+\$", q)
        if found and self.r.random() < 0.4:
            return q + ("？只写结果。" if s == 1 else " Give the result only."), self.r.choice(found)
        words = ["是", "否", "是。", "否。", "能", "不能。", "能。", "对", "不对。", "成立", "不成立。", "可以。", "不可以。", "不会。"] if s == 1 else ["Yes", "No", "Yes.", "No.", "yes", "no", "True", "False", "It does.", "It cannot."]
        return q + ("？只答是或否。" if s == 1 else " Answer yes or no."), self.r.choice(words)

    def examples(self) -> tuple[list[str], list[str], list[int]]:
        """Questions, answers and labels (0 sound, else 1 + index of the label)."""
        qs, as_, ys = [], [], []

        def add(q: str, a: str | None, y: int) -> None:
            if a is not None:
                qs.append(q)
                as_.append(a)
                ys.append(y)

        for (q, a), s in zip(self.pairs, self.spoken_q):
            add(q, a, 0)
            for k, name in enumerate(LABELS):
                if name != "other_language":
                    add(q, getattr(self, name)(q, a, s), k + 1)
            if got := self.foreign(q, a, s):
                add(q, got[0], 1 + LABELS.index("other_language"))
                if self.r.random() < 0.5:  # the same answer is sound where the question asks for its language
                    add(self.asking(q, got[1]), got[0], 0)
            add(q, self.truncated(q, a, s), 2)
            if (made := self.listed(q, a, s)) and self.r.random() < 0.8:
                add(q, made, 0)
                add(q, self.truncated(q, made, s), 2)
            if self.r.random() < 0.2:
                add(q, self.concluded(a, s), 0)
            if self.r.random() < 0.2 and (made := self.blocked(a)):
                add(q, self.noise(made), 0)
                add(q, self.truncated(q, made, s), 2)
            if self.r.random() < 0.15:
                add(*self.brief(q, s), 0)
            if self.r.random() < 0.15:
                add(*self.restated(q, a), 0)
        return qs, as_, ys

    def once(self) -> tuple[list[str], list[str], list[int]]:
        """One defective pair made of each, cut off ones more often, and sound ones of rarer kinds of some."""
        qs, as_, ys = [], [], []
        for (q, a), s in zip(self.pairs, self.spoken_q):
            name, got = self.r.choice((*LABELS, "truncated", "truncated")), None
            text: str | None = a
            if name == "other_language":
                got = self.foreign(q, a, s)
                text = got and got[0]
            else:
                if name == "truncated" and self.r.random() < 0.3:
                    text = self.listed(q, a, s) or self.blocked(a) or a
                text = getattr(self, name)(q, text, s)
            if text is not None:
                qs, as_, ys = [*qs, q], [*as_, text], [*ys, 1 + LABELS.index(name)]
            kind, sound = self.r.random(), None
            if kind < 0.1:
                made = self.listed(q, a, s)
                sound = made and (q, made)
            elif kind < 0.14:
                made = self.concluded(a, s)
                sound = made and (q, made)
            elif kind < 0.18:
                made = self.blocked(a)
                sound = made and (q, self.noise(made))
            elif kind < 0.21:
                sound = self.brief(q, s)
            elif kind < 0.24:
                sound = self.restated(q, a)
            elif got and kind < 0.6:  # the same answer is sound where the question asks for its language
                sound = self.asking(q, got[1]), got[0]
            if sound:
                qs, as_, ys = [*qs, sound[0]], [*as_, sound[1]], [*ys, 0]
        return qs, as_, ys


def _scripts(texts: list[str]) -> list[int]:
    return script(Masked(pa.array(texts, pa.string())).shares()).tolist()


def _matrix(qs: list[str], as_: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offs, idx, val, at = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], 0
    for i in range(0, len(qs), 2000):
        o, x, v = features(pa.array(qs[i : i + 2000], pa.string()), pa.array(as_[i : i + 2000], pa.string()), known)
        offs.append(o[1:] + at)
        at += o[-1]
        idx.append(x)
        val.append(v)
    return np.concatenate(offs), np.concatenate(idx), np.concatenate(val)


def _onehot(ys: list[int]) -> np.ndarray:
    y = np.zeros((len(ys), len(LABELS)))
    for i, k in enumerate(ys):
        if k:
            y[i, k - 1] = 1
    return y


def levels(s: np.ndarray, y: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Each label's threshold from scores of pairs that had not trained, their labels, and scores of the pairs as they are."""
    out = np.zeros(len(LABELS))
    for k in range(len(LABELS)):
        good, bad = np.sort(s[y == k + 1, k]), np.sort(s[y == 0, k])
        if not len(good) or not len(bad):
            continue
        grid = np.linspace(-4, 8, 241)
        recall = 1 - np.searchsorted(good, grid) / len(good)
        # cleaning leaves a few defective pairs among the sound ones
        alarm = np.maximum(0, 1 - np.searchsorted(bad, grid) / len(bad) - LEFT_OVER)
        share, level = 0.02, 0.0
        for _ in range(3):
            f1 = 2 * share * recall / (share * recall + alarm * (1 - share) + share)
            level = float(np.median(grid[f1 >= f1.max() - 1e-6]))
            share = float(np.clip((plain[:, k] > level).mean(), 0.002, 0.5))
        out[k] = level
    return out


def gone_on(pairs: list[tuple[str, str]], known: np.ndarray, state: list[np.ndarray], *, seed: int = 7) -> np.ndarray:
    """Weights after a pass over these pairs from a state of training, which stays as it is; 0 is the calibrated threshold."""
    state = [np.array(x, float) for x in state]
    told, labels, plain = [], [], []
    for i in range(0, len(pairs), 600):
        some = pairs[i : i + 600]
        w = np.ascontiguousarray(state[0].T)
        off, idx, val = _matrix([q for q, _ in some], [a for _, a in some], known)
        s = scores(off, idx, val, w)
        plain.append(s)
        sound = np.flatnonzero(~(s[:, : len(DEFECTS)] > 0.5).any(axis=1))
        if not len(sound):
            continue
        qs, as_, ys = Maker([some[j] for j in sound.tolist()], seed + i).once()
        made = _matrix(qs, as_, known)
        told += [s[sound], scores(*made, w)]
        labels += [np.zeros(len(sound), int), np.array(ys, int)]
        size = np.diff(off)[sound]
        at = np.repeat(off[sound] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        y = _onehot([0] * len(sound) + ys)
        fit(np.concatenate([[0], np.cumsum(size), int(size.sum()) + made[0][1:]]), np.concatenate([idx[at], made[1]]), np.concatenate([val[at], made[2]]), y, seed=seed + i, state=state)
    w = np.ascontiguousarray(state[0].T)
    if told:
        w[-1] -= levels(np.concatenate(told), np.concatenate(labels), np.concatenate(plain))
    return w


def train(pairs: list[tuple[str, str]], *, seed: int = 7, known: np.ndarray | None = None, state: list[np.ndarray] | None = None) -> Model:
    """A model with offsets moved so that 0 is each label's calibrated threshold.

    The threshold is the score at which a label's made pairs, kept out of training, balance recall against false alarms among
    kept-out sound pairs, at the share of the defect that the threshold itself then finds among the given pairs. Pairs without
    letters in the answer make no examples; where none is left nothing is flagged. ``known`` gives the tables of language, and
    ``state`` takes what training can go on from.
    """
    given, told = pairs, known
    solid = Masked(pa.array([a for _, a in pairs], pa.string())).letters > 0 if pairs else np.zeros(0, bool)
    pairs = [x for x, ok in zip(pairs, solid) if ok]
    if not pairs:
        return Model(np.zeros(((1 << BITS) + 1, len(LABELS))) - 1, np.zeros((ASKS + 1, 1 << LANGUAGE_BITS)))
    cut = max(1, len(pairs) * 4 // 5)
    base, kept = pairs[:cut], pairs[cut:]

    def languages_of(rows: list[tuple[str, str]]) -> np.ndarray:
        maker = Maker(rows, seed + 3)
        return languages(rows, [maker.asking(q, maker.r.choice(sorted(REQUESTS))) for q, _ in rows])

    known = languages_of(base) if told is None else told
    qs, as_, ys = Maker(base[: max(1, len(base) // 2)], seed).examples()
    w = fit(*_matrix(qs, as_, known), _onehot(ys), steps=STEPS // 2)

    def clean(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
        if not rows:
            return rows
        s = scores(*_matrix([q for q, _ in rows], [a for _, a in rows], known), w)
        return [x for x, bad in zip(rows, (s[:, : len(DEFECTS)] > 0.5).any(axis=1)) if not bad]

    base, kept = clean(base) or base, clean(kept)
    known = languages_of(base) if told is None else told
    qs, as_, ys = Maker(base, seed + 1).examples()
    w = fit(*_matrix(qs, as_, known), _onehot(ys), state=state)
    if kept:
        qs, as_, ys = Maker(kept, seed + 2).examples()
        y = np.array(ys)
        s = scores(*_matrix(qs, as_, known), w)
        plain = scores(*_matrix([q for q, _ in given], [a for _, a in given], known), w)
        w[-1] -= levels(s, y, plain)
    return Model(w, known)


def fitted(df: DataFrame, key: str, question: str, answer: str, *, part: int = PART, seed: int = 7) -> Model:
    """A model of all pairs of a table: they are dealt into parts of about ``part`` pairs; the first trains a model, the others go on from it, and these are averaged."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    order = F.xxhash64(F.lit(seed), "k")
    parts = max(1, -(-rows.count() // part))
    if parts == 1:
        return train([(r["q"] or "", r["a"] or "") for r in rows.orderBy(order, "q", "a").collect()], seed=seed)
    spark = df.sparkSession

    def solid(own: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Pairs without letters in the answer make no examples."""
        return [x for x, n in zip(own, Masked(pa.array([a for _, a in own], pa.string())).letters.tolist()) if n]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = []
        for batch in batches:
            for some in slices(batch, 2000):
                if own := solid([(q or "", a or "") for q, a in zip(*(c.to_pylist() for c in some.columns))]):
                    maker = Maker(own, seed + 3)
                    told = language_counts(own, [maker.asking(q, maker.r.choice(sorted(REQUESTS))) for q, _ in own])
                    total = [x + y for x, y in zip(total, told)] if total else list(told)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pack_cells(x.astype(np.int64))], pa.binary()) for x in total], names=["counts", "runs"])

    counts, runs = np.zeros((ASKS, 1 << LANGUAGE_BITS)), np.zeros((2, 1 << LANGUAGE_BITS))
    for r in rows.select("q", "a").mapInArrow(count, "counts binary, runs binary").toLocalIterator():  # one of a task
        counts, runs = counts + unpack_cells(bytes(r["counts"]), np.int64).reshape(ASKS, -1), runs + unpack_cells(bytes(r["runs"]), np.int64).reshape(2, -1)
    known = told_languages(counts, runs)
    dealt = rows.withColumn("part", F.pmod(order, F.lit(parts)))
    first = solid([(r["q"] or "", r["a"] or "") for r in dealt.where("part = 0").orderBy(order, "q", "a").collect()])  # about PART
    state: list[np.ndarray] = []
    begun = train(first, seed=seed, known=known, state=state)
    if not state:
        state = [np.zeros((len(LABELS), (1 << BITS) + 1)), np.full((len(LABELS), (1 << BITS) + 1), 1e-4)]
    shared = spark.sparkContext.broadcast([pack_cells(x.astype(np.float32)) for x in (known, *state)])  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, *begin = (unpack_cells(x, np.float32).reshape(n, -1) for x, n in zip(shared.value, (ASKS + 1, len(LABELS), len(LABELS))))
        own: list[tuple[str, str]] = []
        at, n, total = None, 0, None

        def add() -> None:
            nonlocal n, total
            if some := solid(own):
                w = len(some) * gone_on(some, told, begin, seed=seed)
                n, total = n + len(some), w if total is None else total + w
            own.clear()

        for batch in batches:
            for which, q, a in zip(*(c.to_pylist() for c in batch.columns)):
                if which != at and own:
                    add()
                at = which
                own.append((q or "", a or ""))
        if own:
            add()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pack_cells((total / n).astype(np.float32))], pa.binary())], names=["n", "weights"])

    tasks = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = dealt.where("part > 0").repartition(tasks, "part").sortWithinPartitions("part", order, "q", "a")
    models = written(rest.select("part", "q", "a").mapInArrow(run, "n long, weights binary"), "p2-models")
    total, weights = len(first), len(first) * begun.weights
    for r in models.orderBy("n", F.xxhash64("weights")).toLocalIterator():  # one of a task
        total, weights = total + r["n"], weights + r["n"] * unpack_cells(bytes(r["weights"]), np.float32).reshape(-1, len(LABELS)).astype(float)
    return Model(weights / total, known) if total else train([])


def defects(df: DataFrame, key: str, question: str, answer: str, model: Model) -> DataFrame:
    """(key, and a score over its threshold of 0 for each label); one row per id.

    Null texts count as empty; rows without id are left out; an empty table gives no row.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    shared = df.sparkSession.sparkContext.broadcast(model.packed())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.unpacked(shared.value)
        for batch in batches:
            for part in slices(batch, 2000):
                s = scores(*features(part.column(1), part.column(2), m.spoken), m.weights)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[:, k]) for k in range(len(LABELS)))], names=["k", *LABELS])

    return rows.mapInArrow(run, "k long, " + ", ".join(f"{d} double" for d in LABELS)).dropDuplicates(["k"]).withColumnRenamed("k", key)


def p2_scores(spark, sf_dir: str) -> DataFrame:
    """(row_id, empty, truncated, refusal, copied, other_language, swapped): scores of every record, positive above the threshold."""
    qa = read_table(spark, sf_dir, "qa_pairs")
    return defects(qa, "row_id", "question", "answer", once_fitted("p2", [qa], lambda: fitted(qa, "row_id", "question", "answer")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(row_id, defect): each record over a threshold, with the defect it exceeds most; swapped answers are none of the defects asked for."""
    s = p2_scores(spark, sf_dir)
    top = F.greatest(*DEFECTS)
    pick = F.coalesce(*[F.when(F.col(d) == top, F.lit(d)) for d in DEFECTS])
    return s.where(top > 0).select("row_id", pick.alias("defect"))
