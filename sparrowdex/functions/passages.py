"""Passages of documents, their scores, and prompts made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def passages(title: Column, body: Column, length: int, stride: int, count: int | None, title_words: int = 0) -> Column:
    """Passages of a document: the first title words, then a window of the body.

    Windows begin every ``stride`` words; the last is the first that reaches the end of the body, and there are
    at most ``count`` (None: as many as there are). Without a length, a stride or a body there is one passage, whose body part is empty when
    the length or the body is.
    """
    words, head = split_words(body), F.slice(split_words(title), 1, title_words) if title_words > 0 else F.array().cast("array<string>")
    if length <= 0:
        starts = F.array(F.lit(0))
    elif stride <= 0 or (count is not None and count <= 1):
        starts = F.array(F.lit(0))
    else:
        windows = F.greatest(F.ceil((F.size(words) - length) / stride).cast("int"), F.lit(0)) + 1
        starts = F.transform(F.sequence(F.lit(0), (windows if count is None else F.least(windows, F.lit(count))) - 1), lambda i: i * stride)
    cut = (lambda s: F.slice(words, s + 1, F.lit(length))) if length > 0 else (lambda s: F.array().cast("array<string>"))
    return F.transform(starts, lambda s: F.concat_ws(" ", F.concat(head, cut(s))))


def best_passage(passages: Column, scores: Column) -> Column:
    """The passage of the greatest score, the first on ties; the first if there is one only."""
    return F.try_element_at(passages, F.coalesce(F.array_position(scores, F.array_max(scores)).cast("int"), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: System text and instruction of each prompt; those from 7 number their passages.
PROMPTS = {
    1: ("You answer questions.", "Answer the question from the context."),
    2: ("You answer questions briefly.", "Give a short answer to the question from the context."),
    3: ("You answer questions in a few words.", "Give the shortest exact answer that the context supports."),
    4: ("You read carefully.", "Read the context, then answer the question in a few words."),
    5: ("You are a quiz expert.", "Use the context and what you know; give the answer only."),
    6: ("You name facts.", "Name the one entity, date or number that answers the question."),
    7: ("You answer questions from numbered passages.", "Answer the question from the passages."),
    8: ("You answer briefly from numbered passages.", "Give a short answer that the passages support."),
    9: ("You compare numbered passages.", "Choose the passage that answers best and give its answer only."),
    10: ("You are a quiz expert with numbered passages.", "Use the passages and what you know; give the answer only."),
}
#: Bytes that a prompt's JSON may have; characters taken off at a time when it is too long.
PROMPT_BYTES, TRIM = 20 * 1024 - 64, 256


def prompt(question: Column, passages: Column, kind: int = 1) -> Column:
    """System and user message of a question and its passages."""
    if kind not in PROMPTS:
        raise ValueError(f"unknown prompt {kind}")
    system, told = PROMPTS[kind]
    if kind >= 7:
        context = F.concat_ws("\n", F.transform(passages, lambda p, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(": "), p)))
    else:
        context = F.concat(F.lit("Context: "), F.concat_ws(" ", passages))
    user = F.concat_ws("\n", F.lit(told), context, F.concat(F.lit("Question: "), question), F.lit("Answer:"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def capped_prompt(question: Column, passages: Column, kind: int = 1, most: int = PROMPT_BYTES) -> Column:
    """The prompt with the most leading passages (one at least) whose JSON fits; if one is still too long, the user text
    loses its end, some characters at a time, until it fits or is as short as one such piece."""
    made = F.transform(F.sequence(F.greatest(F.size(passages), F.lit(1)), F.lit(1), F.lit(-1)), lambda n: prompt(question, F.slice(passages, F.lit(1), n), kind))
    fits = lambda p: F.octet_length(F.to_json(p)) <= most
    chosen = F.coalesce(F.try_element_at(F.filter(made, fits), F.lit(1)), F.element_at(made, -1))

    def cut(p: Column) -> Column:
        user = p[1]["content"]
        times = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(user) - TRIM) / TRIM), F.lit(0)).cast("int"))
        shorter = F.transform(times, lambda k: F.array(p[0], F.struct(F.lit("user").alias("role"), F.substr(user, F.lit(1), F.greatest(F.length(user) - k * TRIM, F.lit(0))).alias("content"))))
        return F.coalesce(F.try_element_at(F.filter(shorter, fits), F.lit(1)), F.element_at(shorter, -1))

    return F.element_at(F.transform(F.array(chosen), cut), 1)
