"""Seams for models and tokenizers: Arrow-batched functions with deterministic offline stand-ins.

Every seam takes a factory that is called once per worker process and returns the function for a batch, so a real model
loads once. The stand-ins let the relational logic around a seam run and be tested without one.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batch = Callable[[list[str]], list]


def hashing_embedder(dim: int = 64) -> Callable[[], Batch]:
    """Unit vectors of signed character counts; empty text gives a zero vector.

    A character of code point c adds to place c // 2 modulo ``dim``, or takes away where c is odd.
    """

    def load() -> Batch:
        def embed(texts: list[str]) -> list[list[float]]:
            data = "".join(texts).encode("utf-32-le", "surrogatepass")
            c = np.frombuffer(data, np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            v = np.bincount(row * dim + (c >> 1) % dim, weights=1.0 - 2 * (c & 1), minlength=len(texts) * dim).reshape(len(texts), dim)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return (v / np.where(n > 1e-10, n, 1)).tolist()

        return embed

    return load


def code_points() -> Callable[[], Batch]:
    return lambda: lambda texts: [[ord(c) for c in t] for t in texts]


def ngram_segmenter(n: int = 2) -> Callable[[], Batch]:
    """Words between blanks; runs of ideographs as overlapping n-grams."""

    def load() -> Batch:
        def cut(t: str) -> list[str]:
            out: list[str] = []
            for w in t.split():
                han = all("一" <= c <= "鿿" for c in w)
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))] if han else [w]
            return out

        return lambda texts: [cut(t) for t in texts]

    return load


def rule_scorer() -> Callable[[], Batch]:
    """A reply with a score that grows with the text's length."""
    return lambda: lambda texts: [f"评分：{min(5, len(t) // 80)}" for t in texts]


def echo_generator(mark: str) -> Callable[[], Batch]:
    return lambda: lambda texts: [f"{mark}{hashlib.md5(t.encode()).hexdigest()[:8]}" for t in texts]


def with_retry(fn: Batch, tries: int = 3, pause: float = 0.0) -> Batch:
    """Calls again on failure; the batch's results are null when every try fails."""

    def run(texts: list[str]) -> list:
        for k in range(tries):
            try:
                return fn(texts)
            except Exception:
                if k + 1 < tries and pause:
                    time.sleep(pause)
        return [None] * len(texts)

    return run


def apply(load: Callable[[], Batch], kind: str, *, tries: int = 1) -> Callable[[Column], Column]:
    """A column function from a seam; null texts are passed as empty."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = with_retry(load(), tries) if tries > 1 else load()
        for s in batches:
            yield pd.Series(fn(s.fillna("").tolist()), index=s.index)

    return run


def memoised(df: DataFrame, text: str, out: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Adds ``out`` = fn(text), computing it once for each distinct text."""
    once = df.select(text).distinct().withColumn(out, fn(F.col(text)))
    return df.join(once.withColumnRenamed(text, "__t"), df[text].eqNullSafe(F.col("__t")), "left").drop("__t")


def in_sequence(df: DataFrame, keys: list[str], n: str, load: Callable[[], Batch], out: str = "text") -> DataFrame:
    """Generates ``n`` texts for each row, each prompt holding the row's earlier results: (keys, no from 1, out).

    A row is one section and type with a bounded quota; its prompt travels once, however many texts are asked.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + f", no int, {out} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for pdf in batches:
            for at in range(0, len(pdf), 100):
                rows = []
                for *key, count, prompt in pdf[[*keys, n, "prompt"]].iloc[at : at + 100].itertuples(index=False, name=None):
                    earlier: list[str] = []
                    for no in range(1, count + 1):
                        earlier.append(fn(["\n".join([prompt, *earlier])])[0])
                        rows.append((*key, no, earlier[-1]))
                yield pd.DataFrame(rows, columns=[*keys, "no", out])

    return df.select(*keys, n, "prompt").mapInPandas(run, schema)


def truncated(load: Callable[[], Batch], longest: int) -> Callable[[], Batch]:
    """A seam that sees no more than ``longest`` characters of each text, as a model with a token limit would."""

    def begin() -> Batch:
        fn = load()
        return lambda texts: fn([t[:longest] for t in texts])

    return begin


def answered(df: DataFrame, messages: Column, fn: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds the completion of a row's chat messages, rendered as ChatML."""
    from .text import chatml

    return df.withColumn(out, fn(chatml(messages)))


def augmented_pairs(df: DataFrame, copies: int, ask: Callable[[Column], Column], answer: Callable[[Column], Column]) -> DataFrame:
    """(all columns, copy_no): each pair and ``copies`` - 1 rewordings of its type, the original first.

    A copy's question is generated first, then its answer with that question before it. The number of the copy stands at the
    end of the prompt, so that deterministic generators tell copies apart.
    """
    from . import prompts as P

    rows = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    before = P.varying(F.col("type"), F.col("question"), F.col("answer"))
    own = F.concat(before, P.messages(("user", F.col("copy_no").cast("string"))))
    made = answered(rows.where("copy_no > 0").withColumn("__m", own), F.col("__m"), ask, "__q")
    made = answered(made, P.answering(F.col("__m"), F.col("__q")), answer, "__a")
    made = made.withColumns({"question": F.col("__q"), "answer": F.col("__a")}).drop("__m", "__q", "__a")
    return rows.where("copy_no = 0").unionByName(made)
