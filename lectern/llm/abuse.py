"""Problem 8: abusive, hateful or sexual content by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common character subsequences of length two and three, gaps discounted, so characters put in between cost
little. Labels are given per document, so sentences are labelled by rounds of multiple-instance training: a labelled
document's most suspicious sentences are its positive ones. Landmark sentences span the Nyström space; as the kernel has an
explicit feature map, the machine trained in that space folds into one weight per subsequence, and scoring a corpus is
a handful of table look-ups per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, once_fitted, pack_cells, read_table, slices, string_parts, unpack_cells

BITS = 16
#: Gaps of a subsequence: offsets of its second and third character, and the discount of a skipped character.
PAIRS, TRIPLES, DISCOUNT = (1, 2, 3), ((1, 1), (1, 2), (2, 1), (2, 2)), 0.6
LANDMARKS, ROUNDS, SEED, COST = 448, 3, 11, 0.7
#: Labelled and unlabelled documents taken for training at most (smallest hash of the id first), and characters of each of the two
#: at most; terms read at most.
LABELLED, BACKGROUND, TRAIN_CHARS, TERMS = 3200, 2000, 3_500_000, 10_000
#: Letters a window of a longer sentence holds, from one window's begin to the next, and letters below which a sentence counts as longer.
LONGEST, STRIDE, SHORTEST = 90, 45, 14

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters inside words.
LOOKALIKES = dict(zip("аеорсухіѕјкмтнвԁոɡοαεινρτυκ", "aeopcyxisjkmthbdngoaeivptuk"))
LEET = dict(zip("01345789@$!|", "oieastbgasil"))
#: Formulas between dollar signs that no Latin letter touches; words in one that are no commands.
FORMULA = re.compile(r"(?<![A-Za-z])\$[^$\n]*[\\^_{}=\[\](),][^$\n]*\$(?![A-Za-z])")
PROSE = re.compile(r"(?<![\\A-Za-z])[^\W\d_]{2,}")
ENDS = "。！？!?；;…\n\r"

# Labelled sentences to start from where the labels are few: 1 insults, threatens, demeans or is explicit, 0 is not.
SEEDS = [
    ("You are a worthless idiot and everybody knows it.", 1), ("Shut up, you stupid piece of garbage.", 1), ("Go back to where you came from, filthy vermin.", 1), ("I will find you and beat you until you bleed.", 1),
    ("People like you should be wiped out.", 1), ("Women are too dumb to understand this.", 1), ("Send me nudes or I will ruin your life.", 1), ("Those foreigners are all parasites and scum.", 1), ("Get lost, you pathetic loser.", 1),
    ("She was naked on the bed, moaning and begging for more.", 1), ("Watch free hardcore porn videos here.", 1), ("Only a moron would write such a proof.", 1), ("You ugly pig, nobody wants you here.", 1), ("Kill yourself, you disgusting freak.", 1),
    ("你这个白痴，滚出去。", 1), ("闭嘴吧，你这个没用的废物。", 1), ("去死吧，垃圾东西。", 1), ("你们这种人就是社会的寄生虫。", 1), ("再让我看见你，我就打断你的腿。", 1), ("长得这么丑还敢出来见人，真恶心。", 1), ("外地人都是蟑螂，没有一个好东西。", 1),
    ("女人就该在家生孩子，学什么数学。", 1), ("发几张裸照给我看看，不然有你好看。", 1), ("成人色情视频免费观看。", 1), ("我想摸你的身体，让你叫出声来。", 1), ("你脑子进水了吧，蠢猪。", 1), ("这帮畜生天生低人一等。", 1), ("写这题的人是个不要脸的贱货。", 1),
    ("Halt die Klappe, du dummes Schwein.", 1), ("Verschwinde, du Idiot, sonst setzt es Prügel.", 1), ("Ferme-la, espèce de crétin.", 1), ("Dégage, sale ordure.", 1), ("Cállate, imbécil, eres basura.", 1), ("Lárgate, cerdo asqueroso, o te mato.", 1),
    ("I was such an idiot to overlook this case.", 0), ("The word moron is an insult and must not be used here.", 0), ("We kill the process and beat the baseline.", 0), ("Garbage collection removes dead nodes.", 0), ("Do not call anyone stupid in the forum.", 0), ("A naked singularity is not considered.", 0),
    ("My own proof is garbage, I have to start again.", 0), ("The report quotes the threat and condemns it.", 0), ("Sex ratio at birth follows a binomial distribution.", 0), ("The parasite population doubles each step.", 0), ("Brute force would be a dumb algorithm here.", 0), ("Comments with insults will be deleted.", 0),
    ("我真是个白痴，又算错了。", 0), ("垃圾回收会清除无用的节点。", 0), ("“废物”一词在这里是侮辱，禁止使用。", 0), ("请不要骂别人是猪脑子。", 0), ("杀死进程之后重新运行。", 0), ("寄生虫的数量每天翻倍。", 0), ("性别比例服从二项分布。", 0), ("论坛禁止发布色情内容。", 0), ("裸数据需要先清洗。", 0), ("我的证明就是一堆垃圾，重写。", 0),
    ("Ich Idiot habe das Vorzeichen vergessen.", 0), ("Je suis un crétin, j'ai oublié un cas.", 0), ("Soy un imbécil, olvidé el caso base.", 0),
]

_TABLE: dict[str, np.ndarray] = {}


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its letter in lower case without accents (0: no letter), and the letter a digit or sign may stand for."""
    if "f" not in _TABLE:
        import unicodedata

        out, leet = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)
        for i in range(0x20, 0x30000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                base = unicodedata.normalize("NFKD", c)[0].lower()[0] if not 0xAC00 <= i <= 0xD7A3 else c
                out[i] = ord(LOOKALIKES.get(base, base))
        for k, v in LEET.items():
            leet[ord(k)] = leet[ord(k) + 0xFEE0] = ord(v)
        _TABLE["f"], _TABLE["l"] = out, leet
    return _TABLE["f"], _TABLE["l"]


def without_formulas(t: str) -> str:
    """The text without its formulas; those that hold words follow as sentences of their own."""
    spoken = [x for x in FORMULA.findall(t) if len(PROSE.findall(x)) > 1] if "$" in t else []
    return "\n".join([FORMULA.sub(" ", t), *(x.replace("$", " ") for x in spoken)])


def letters(texts: list[str], *, training: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as folded letters, with the sentence and the text each letter belongs to (sentences numbered through).

    For training, windows stand side by side and formulas are left out, so that no letter counts twice.
    """
    fold, leet = _fold()
    cp, off = string_parts(pa.array([FORMULA.sub(" ", t) if training else without_formulas(t) for t in texts], pa.string()))
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.minimum(cp, 0x10FFFF)
    sym = fold[cp]
    latin = (sym < 0x250) & (sym > 0)
    # marks and invisible characters vanish; a digit or sign between Latin letters stands for a letter
    near = np.zeros(n, bool)
    near[1:] |= latin[:-1]
    near[:-1] |= latin[1:]
    stand = leet[cp]
    sym = np.where((sym == 0) & (stand > 0) & near, stand, sym)
    white = (cp == 32) | (cp == 9) | (cp == 0x3000) | (cp == 0xA0)
    end = np.isin(cp, np.array([ord(c) for c in ENDS], np.uint32)) & ~((sym > 0) & near)
    dot = cp == 46
    dot[:-1] &= white[1:] | (cp[1:] == 10)
    end |= dot
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    # a sentence ends behind its mark, a text behind its last character; runs of marks make one end
    sentence = np.cumsum(np.r_[False, end[:-1]] | np.r_[True, owner[1:] != owner[:-1]]) - 1
    latin = (sym < 0x250) & (sym > 0)
    blank = white & (sym == 0)
    last = np.maximum.accumulate(np.where(latin | ((sym > 0) & ~latin), np.arange(n), -1))
    after_latin = np.r_[False, (latin[np.maximum(last[:-1], 0)]) & (last[:-1] >= 0)]
    keep = (sym > 0) | (blank & after_latin & ~np.r_[False, blank[:-1]])
    sym = np.where(blank & keep, 32, sym)
    sym, sentence, owner = sym[keep], sentence[keep], owner[keep]
    # over-long sentences are read through overlapping windows, so that whatever stands across a border is whole in the next one
    if len(sym):
        begin = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        size = np.diff(np.r_[begin, len(sym)])
        stride = LONGEST if training else STRIDE
        count = np.where(size > LONGEST, -(-(size - LONGEST) // stride) + 1, 1)
        which = np.repeat(np.arange(len(begin)), count)
        start = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * stride
        length = np.minimum(size[which] - start, LONGEST)
        sentence = np.repeat(np.arange(len(which)), length)
        at = np.arange(len(sentence)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin[which] + start, length)
        sym, owner = sym[at], owner[at]
    return sym, sentence, owner


def subsequences(sym: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Positions, feature ids and weight of each kind of subsequence that stays inside a sentence."""
    c = mix64(sym.astype(np.uint64) + np.uint64(0x1234567))
    n = len(c)
    for d in PAIRS:
        if n > d:
            at = np.flatnonzero(sentence[:-d] == sentence[d:])
            h = (c[at] * np.uint64(3) + c[at + d] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at + d] >> np.uint64(29))
            yield at, (h >> np.uint64(64 - BITS)).astype(np.int64), 0.7 * DISCOUNT ** (d - 1)
    for d, e in TRIPLES:
        if n > d + e:
            at = np.flatnonzero(sentence[: -(d + e)] == sentence[d + e :])
            h = c[at] * np.uint64(5) + c[at + d] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + d + e] * np.uint64(0x165667B19E3779F9)
            yield at, ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64), DISCOUNT ** (d + e - 2)


def sentence_scores(sym: np.ndarray, sentence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of each sentence by folded weights; the last weight is the offset."""
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    each = np.zeros(len(sym))
    for at, h, w in subsequences(sym, sentence):
        each[at] += weights[h] * w
    size = np.bincount(sentence, minlength=n)
    return np.bincount(sentence, weights=each, minlength=n) / np.sqrt(np.maximum(size, SHORTEST)) + weights[-1]


class Sentences:
    """Sparse feature rows of sentences, scaled as in :func:`sentence_scores`."""

    def __init__(self, texts: list[str], block: int = 200):
        owner, idx, val, per = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), block):
            sym, sentence, own = letters(texts[i : i + block], training=True)
            if not len(sym):
                continue
            n = int(sentence[-1]) + 1
            owner.append(own[np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])] + i)
            scale = 1 / np.sqrt(np.maximum(np.bincount(sentence, minlength=n), SHORTEST))
            parts = [(sentence[at], h, w * scale[sentence[at]]) for at, h, w in subsequences(sym, sentence)]
            row, ids, vals = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(row, kind="stable")
            idx.append(ids[order].astype(np.int32))
            val.append(vals[order].astype(np.float32))
            per.append(np.bincount(row, minlength=n))
        self.owner, self.idx, self.val = np.concatenate(owner), np.concatenate(idx), np.concatenate(val)
        self.off = np.concatenate([[0], np.cumsum(np.concatenate(per))]).astype(np.int64)
        self.n = len(self.off) - 1

    def rows(self, rows: np.ndarray) -> Sentences:
        out = object.__new__(Sentences)
        n = self.off[rows + 1] - self.off[rows]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.off[rows], n)
        out.idx, out.val, out.off, out.n, out.owner = self.idx[at], self.val[at], np.concatenate([[0], np.cumsum(n)]), len(rows), self.owner[rows]
        return out

    def dot(self, table: np.ndarray, block: int = 50) -> np.ndarray:
        """Products with a table of one row per feature, in blocks."""
        out = np.zeros((self.n, table.shape[1]), np.float32)
        for i in range(0, self.n, block):
            j = min(self.n, i + block)
            lo, hi = self.off[i], self.off[j]
            filled = np.flatnonzero(np.diff(self.off[i : j + 1]))
            if len(filled):
                out[i + filled] = np.add.reduceat(table[self.idx[lo:hi]] * self.val[lo:hi, None], self.off[i:j][filled] - lo, axis=0)
        return out

    def weighted(self, w: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(w[self.idx] * self.val, dtype=np.float64)])
        return run[self.off[1:]] - run[self.off[:-1]]

    def dense(self, rows: np.ndarray) -> np.ndarray:
        table = np.empty((1 << BITS, len(rows)), np.float32)
        for k, r in enumerate(rows.tolist()):
            table[:, k] = np.bincount(self.idx[self.off[r] : self.off[r + 1]], weights=self.val[self.off[r] : self.off[r + 1]], minlength=1 << BITS)
        return table


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Squared-hinge linear SVM with an offset, by accelerated gradient."""
    x = np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1).astype(np.float64)
    w = v = np.zeros(x.shape[1])
    u = np.ones(x.shape[1])
    for _ in range(12):  # largest curvature by power iteration
        u = x.T @ (cost * (x @ u))
        size = np.linalg.norm(u)
        u /= size + 1e-12
    lip, t = 2 * size + 1, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = v * np.r_[np.ones(x.shape[1] - 1), 0] - 2 * x.T @ (cost * y * slack)
        new = v - g / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def train(docs: list[tuple[str, int]], background: list[str], terms: list[tuple[str, int]], *, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Folded weights with offset from (text, label) of documents, unlabelled texts (nearly all clean) and (term, weight) of starting terms."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in docs] + [0] * len(background) + [y for _, y in SEEDS])
    s = Sentences([t for t, _ in docs] + background + [t for t, _ in SEEDS])
    bag = labels[s.owner]
    seeded = (s.owner >= len(labels) - len(SEEDS)) & (bag == 1)
    trust = np.where((s.owner >= len(docs)) & (s.owner < len(docs) + len(background)), 0.5, 1.0)
    # first guess: features that stand in labelled documents rather than in clean ones, and the given terms
    in_bad, in_good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    edges = np.searchsorted(s.owner, np.arange(0, len(labels) + 200, 200))
    for lo, hi in zip(edges[:-1], edges[1:]):  # documents in blocks
        pairs = np.repeat(s.owner[lo:hi], np.diff(s.off[lo : hi + 1])) * (1 << BITS) + s.idx[s.off[lo] : s.off[hi]]
        pairs.sort()
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        bad = labels[pairs >> BITS] == 1
        in_bad += np.bincount(pairs[bad] & ((1 << BITS) - 1), minlength=1 << BITS)
        in_good += np.bincount(pairs[~bad] & ((1 << BITS) - 1), minlength=1 << BITS)
    share = labels.mean()
    odds = np.clip(np.log((in_bad + 8 * share) / (in_good + 8 * (1 - share))) - np.log(share / (1 - share)), -1, 3)
    odds[in_bad < 2] = np.minimum(odds[in_bad < 2], 0)
    t = Sentences([x for x, w in terms if w >= 2 and x])
    if t.n:
        odds[np.unique(t.idx)] += 0.5
    f = s.weighted(odds)
    f = (f - np.median(f)) / (np.std(f) + 1e-9)

    def lead(f: np.ndarray) -> np.ndarray:
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, s.owner, f)
        return f >= top[s.owner] - 1e-9

    y = np.where((bag == 1) & lead(f) & (f > 2.0) | seeded, 1, np.where((bag == 0) | (f < 1.0), -1, 0))
    w = np.zeros((1 << BITS) + 1)
    for r in range(rounds):
        pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
        if not len(pos) or not len(neg):
            break
        hard = neg[np.argsort(-f[neg])[: 3 * landmarks]]
        marks = np.unique(np.concatenate([rng.choice(pos, min(len(pos), landmarks // 2), replace=False), rng.choice(hard, min(len(hard), landmarks // 4), replace=False), rng.choice(neg, min(len(neg), landmarks // 4), replace=False)]))
        table = s.dense(marks)
        val, vec = np.linalg.eigh((table.T @ table).astype(np.float64))
        ok = val > 1e-4 * val.max()
        half = vec[:, ok] / np.sqrt(val[ok])
        some = np.unique(np.concatenate([pos, hard, rng.choice(neg, min(len(neg), 3000), replace=False)]))
        z = s.rows(some).dot(table).astype(np.float64) @ half
        yy = y[some].astype(float)
        cost = COST * trust[some] * np.where(yy > 0, 2.0, 1.0)
        svm = _svm(z, yy, cost)
        w[:-1] = table.astype(np.float64) @ (half @ svm[:-1])
        w[-1] = svm[-1]
        f = s.weighted(w) + w[-1]
        y = np.where((bag == 1) & ((lead(f) & (f > -0.2)) | (f > 0.3)) | seeded, 1, np.where((bag == 0) | (f < -0.3), -1, 0))
        # an unlabelled sentence that looks plainly abusive is not held against its kind
        y = np.where((trust < 1) & (f > 0.6), 0, y)
    return w


def threshold(w: np.ndarray, docs: list[tuple[str, int]], unlabelled: list[str]) -> float:
    """The document score that separates labelled documents kept out of training.

    Among levels about as good as the best one, the one around which the fewest unlabelled documents lie: clean and abusive
    documents leave a gap between them, which a few, partly wrong labels don't show.
    """
    if len(docs) < 20:
        return 0.0
    s = doc_scores([t for t, _ in docs], w)
    y = np.array([k for _, k in docs])
    grid = np.linspace(-0.5, 0.8, 53)
    f1 = np.array([2 * ((s > g) & (y == 1)).sum() / max(1, (s > g).sum() + (y == 1).sum()) for g in grid])
    u = np.sort(np.concatenate([s, doc_scores(unlabelled, w)])) if unlabelled else s
    near = np.searchsorted(u, grid + 0.12) - np.searchsorted(u, grid - 0.12)
    fair = f1 >= f1.max() - 0.04
    return float(np.median(grid[fair & (near <= near[fair].min())]))


def doc_scores(texts: list[str], w: np.ndarray) -> np.ndarray:
    """The highest sentence score of each text; -1 where it holds no letters."""
    out = np.full(len(texts), -1.0)
    sym, sentence, owner = letters(texts)
    if len(sym):
        f = sentence_scores(sym, sentence, w)
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner[first], f)
        out = np.where(np.isfinite(best), best, -1.0)
    return out


def fitted(labelled: list[tuple[str, int]], background: list[str], terms: list[tuple[str, int]]) -> np.ndarray:
    """Weights whose offset puts the threshold, set on a sixth of the labelled documents kept out of training, at 0."""
    cut = len(labelled) * 5 // 6
    half = len(background) // 2
    w = train(labelled[:cut], background[:half], terms)
    w[-1] -= threshold(w, labelled[cut:], background[half:])
    return w


def _drawn(docs: DataFrame, most: int) -> list:
    """Documents with text in order of their hashed id: at most ``most``, as long as they hold no more than TRAIN_CHARS characters."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    rows = docs.where(F.length("text") > 0).withColumn("__o", order)
    sizes = rows.select("__o", F.length("text").alias("n")).orderBy("__o", "n").limit(most).collect()
    upto = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), TRAIN_CHARS, side="right"))
    return rows.where(F.col("__o") <= F.lit(sizes[upto - 1]["__o"])).orderBy("__o", "text").collect() if upto else []


def model(docs: DataFrame, labels: DataFrame, terms: DataFrame, *, labelled: int = LABELLED) -> np.ndarray:
    """Folded weights fitted to labelled and some unlabelled documents.

    Conflicting or null labels of a document do not count; without any labels the built-in sentences and the terms alone train
    the machine.
    """
    verdicts = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = hi")
    few = verdicts.orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(labelled).select("doc_id", F.col("hi").alias("label"))
    rows = _drawn(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), labelled)  # at most so many ids
    # hashes below this bound hold about four times the unlabelled texts that are wanted
    bound = int((min(1.0, 4 * BACKGROUND / max(1, docs.count())) - 0.5) * 2**64 * (1 - 1e-9))
    known_ids = {r["doc_id"] for r in rows}
    others = [r["text"] for r in _drawn(docs.select("doc_id", "text").where(F.xxhash64(F.lit(SEED), "doc_id") <= F.lit(bound)), 2 * BACKGROUND) if r["doc_id"] not in known_ids][:BACKGROUND]
    known = [(r["term"], r["weight"] or 0) for r in terms.where(F.col("term").isNotNull()).orderBy(F.desc_nulls_last("weight"), "term").limit(TERMS).collect()]
    return fitted([(r["text"], r["label"]) for r in rows], others, known)


def abuse_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, source, score): flagged where the score is above 0. Null, empty and letterless texts score -1."""
    shared = docs.sparkSession.sparkContext.broadcast(pack_cells(weights.astype(np.float32)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpack_cells(shared.value, np.float32).astype(np.float64)
        for batch in batches:
            for part in slices(batch, 500):
                s = doc_scores([x or "" for x in part.column(2).to_pylist()], w)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s)], names=["doc_id", "source", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, score double")


def _scored(spark, sf_dir: str) -> DataFrame:
    docs, labels, terms = (read_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "abuse_terms"))
    return abuse_scores(docs, once_fitted("p8", [docs, labels, terms], lambda: model(docs, labels, terms)))


def p8_scores(spark, sf_dir: str) -> DataFrame:
    """(doc_id, score) of every document."""
    return _scored(spark, sf_dir).select("doc_id", "score")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id): documents scored above the threshold."""
    return _scored(spark, sf_dir).where("score > 0").select("doc_id")


def p8_rates(spark, sf_dir: str) -> DataFrame:
    """(source, documents, flagged, rate) per source; the null source is one of them."""
    flagged = F.count(F.when(F.col("score") > 0, 1))
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"))
