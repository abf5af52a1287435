"""Chat contexts and label-masked training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORED = -100


def role(c: Column) -> Column:
    """user, assistant, system or other, whatever the spelling."""
    r = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(r.isin("user", "assistant", "system"), r).when(r.isin("bot", "ai", "model"), "assistant").when(r == "human", "user").otherwise("other")


def adjacent_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn and the assistant turn right after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages.select("conv_id", "turn", role(F.col("role")).alias("role"), "content")
    m = m.withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w), "answer": F.lead("content").over(w)})
    return m.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1").select("conv_id", "turn", F.col("content").alias("question"), "answer")


def chat_contexts(messages: DataFrame, *, history: bool = True) -> DataFrame:
    """(conv_id, turn, context): for each user turn the system message and all turns up to it as role and content.

    A conversation is a bounded group, and the contexts of its n turns hold about n * n / 2 messages, as asked for; without
    history the context holds system and current turn alone.
    """
    m = messages.select("conv_id", "turn", role(F.col("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.collect_list(F.struct("role", "content")).over(w)
    if not history:
        upto = F.filter(upto, lambda x: x["role"] == "system")
        return m.withColumn("__s", upto).where("role = 'user'").select("conv_id", "turn", F.concat("__s", F.array(F.struct("role", "content"))).alias("context"))
    return m.withColumn("context", upto).where("role = 'user'").select("conv_id", "turn", "context")


def earlier_questions(df: DataFrame, keys: list[str], order: str, question: str) -> DataFrame:
    """Adds ``earlier``: the questions before a row in its group.

    ``keys`` must name groups of bounded size, such as a section's quota of one type, since the lists of a group grow with its square.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("earlier", F.collect_list(question).over(w))


def token_codes(c: Column) -> Column:
    """The stand-in tokenizer: code points."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def masked_rows(df: DataFrame, prompt_ids: Column, response_ids: Column, max_length: int) -> DataFrame:
    """Adds input_ids, attention_mask, labels: prompt then response within the limit, the prompt's labels masked."""
    room = F.greatest(F.lit(max_length) - F.size(prompt_ids), F.lit(0))
    p = F.slice(prompt_ids, 1, max_length)
    r = F.when(room > 0, F.slice(response_ids, F.lit(1), room)).otherwise(F.array().cast("array<int>"))
    ids = F.concat(p, r)
    return df.withColumns({"input_ids": ids, "attention_mask": F.array_repeat(F.lit(1), F.size(ids)), "labels": F.concat(F.array_repeat(F.lit(IGNORED), F.size(p)), r)})


def padded(df: DataFrame, batch: str, pad: int = 0) -> DataFrame:
    """Pads the rows of each batch to its longest one; labels with the ignored label, the mask with 0."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("__w"))
    out = df.join(longest, batch)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__w") - F.size(c)))
    return out.withColumns({"input_ids": fill("input_ids", pad), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", IGNORED)}).drop("__w")
