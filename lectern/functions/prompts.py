"""Chat messages for the models behind the seams, as arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the models are told. {kind}, {text}, {earlier}, {question} and {answer} stand for a row's own texts.
SCORE_SYSTEM = """你是一位严谨的离散数学QA质量评审专家。你的任务是对给定的【问题-答案】对进行质量评分。

请从准确性、完整性、逻辑性、表述清晰度、答案详细程度五个维度综合给出一个整数评分（0-5分），仅输出评分，不要输出任何解释。评分标准如下：

- 5分：完全正确，答案完整、清晰，与课程材料一致，可直接用于教学。
- 4分：基本正确，略有不足，但核心信息准确。
- 3分：部分正确，存在小错误，但不影响对核心概念的理解。
- 2分：错误较多，核心信息不准确。
- 1分：完全错误或答非所问。
- 0分：无效内容。

仅输出一个整数0-5，不要包含任何其他文字。"""
SCORE_USER = "请评估以下离散数学QA对的质量：\n\n问题：{question}\n\n答案：{answer}"
WRITE_SYSTEM = "你的任务是，根据所给定的“离散数学课程教材文档”，生成QA问答对。根据用户的指引，先生成问题，再生成答案。不要有任何多余输出，只生成问答。不能出现“问题：”“答案：”等字眼。也不能出现“根据教材内容”等字眼。必须使用中文。不能出现与成绩相关的问题，如“离散数学课程的成绩构成包括哪些部分？”\n"
VARY_SYSTEM = "你的任务是，根据所给定的“离散数学课程QA问答对”，额外生成：相同意思但表达方式不同的QA问答对。注意，表达方式不能相差过大。根据用户的指引，先生成问题，再生成答案。不要有任何多余输出，只生成问答。不能出现“问题：”“答案：”等字眼。也不能出现“根据教材内容”等字眼。必须使用中文。不能出现与成绩相关的问题，如“离散数学课程的成绩构成包括哪些部分？”\n"
KIND_SYSTEM = "【重要！！！】生成的qa必须属于【{kind}】，这点请务必遵守。\n"
TEXT_SYSTEM = "给出的课程教材如下：{text}, 必须在知识中随机的选取知识点提问。一定要随机，减少重复内容。\n"
PAIR_SYSTEM = "给出的原始QA问答对如下：问题：{question}\n答案：{answer}\n。请将qa对控制在1024字以内。如果原qa问答超过了1024字，请将生成的qa问答对控制在1024字以内。\n"
EARLIER_SYSTEM = "你已经给出了如下问题：\n{earlier}\n请避免重复问题。\n"
ASK_QUESTION = "请先根据教材文档生成一个与课程相关的问题。只生成问题，不要给出解答。\n"
ASK_ANSWER = "请再根据教材文档，生成你先前生成的问题的解答。简要写清楚解答思路和过程。只生成解答，不要额外生成问题。\n"


def filled(template: str, **values: Column) -> Column:
    """A template with columns in the places of their names."""
    import re

    parts = [x for x in re.split(r"(\{\w+\})", template) if x]
    return F.concat(*[values[p[1:-1]] if p[0] == "{" and p[-1] == "}" else F.lit(p) for p in parts])


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def scoring(question: Column, answer: Column) -> Column:
    return messages(("system", F.lit(SCORE_SYSTEM)), ("user", filled(SCORE_USER, question=question, answer=answer)))


def asking(kind: Column, text: Column, earlier: Column) -> Column:
    """For a new question on a text; ``earlier`` holds the questions asked before, one a line."""
    return messages(("system", F.lit(WRITE_SYSTEM)), ("system", filled(KIND_SYSTEM, kind=kind)), ("system", filled(TEXT_SYSTEM, text=text)), ("system", filled(EARLIER_SYSTEM, earlier=earlier)), ("user", F.lit(ASK_QUESTION)))


def varying(kind: Column, question: Column, answer: Column) -> Column:
    """For a question that says the same as a given one in other words."""
    return messages(("system", F.lit(VARY_SYSTEM)), ("system", filled(KIND_SYSTEM, kind=kind)), ("system", filled(PAIR_SYSTEM, question=question, answer=answer)), ("user", F.lit(ASK_QUESTION)))


def answering(before: Column, question: Column) -> Column:
    """For the answer to a question that was asked by ``before``."""
    return F.concat(before, messages(("assistant", question), ("user", F.lit(ASK_ANSWER))))
