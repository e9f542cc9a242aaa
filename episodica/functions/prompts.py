"""Prompts, the messages of the environment, and checks of both, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_action, strip


def render(template: str, question: Column) -> Column:
    """The template with the question in place of ``{question}``; null if the question is blank."""
    q = strip(F.coalesce(question, F.lit("")))
    return F.when(q != "", F.replace(F.lit(template), F.lit("{question}"), q))


def prompt_check(prompt: Column, question: Column, template: str) -> Column:
    """struct(prompt, error) of a row's own prompt, an array of (role, content), which must be the rendered
    template: the first thing that is wrong, or the prompt."""
    want, first = render(template, question), F.get(prompt, F.lit(0))
    error = (
        F.when(want.isNull(), "empty_question")
        .when(prompt.isNull(), "missing_dataset_prompt")
        .when(F.size(prompt) == 0, "invalid_dataset_prompt")
        .when(~first["role"].eqNullSafe(F.lit("user")), "invalid_dataset_prompt_role")
        .when(~first["content"].eqNullSafe(want), "dataset_prompt_drift")
    )
    return F.struct(F.when(error.isNull(), want).alias("prompt"), error.alias("error"))


def model_input(rendered: Column, trajectory: Column, opener: bool = True, reminder: Column | None = None) -> Column:
    """What the model reads next: the rendered prompt, the trajectory, and the opener that the environment gives
    to every action but the first. A prompt that ends in an opener takes that of the first action."""
    t = F.coalesce(trajectory, F.lit(""))
    joined = F.when(rendered.rlike(r"(?i)<think>\s*\z"), F.regexp_replace(t, r"(?i)\A\s*<think>", "")).otherwise(t)
    hint = F.coalesce(F.concat(F.lit("\n\n"), strip(reminder)), F.lit("")) if reminder is not None else F.lit("")
    prefix = F.concat(hint, F.lit("\n\n<think>\n")) if opener else F.lit("")
    return F.concat(rendered, joined, F.when(t != "", prefix).otherwise(""))


def overflow(prompt_tokens: Column, new_tokens: int, limit: int) -> Column:
    return F.when(prompt_tokens + new_tokens > limit, "context_overflow")


def event_error(kind: Column, text: Column) -> Column:
    """What is wrong with one event of a trace by itself, else null."""
    t = strip(F.coalesce(text, F.lit("")))
    block = t.startswith("<information>") & t.endswith("</information>")
    return (
        F.when(t == "", "empty_event")
        .when(kind == "generated", parse_action(t)["error"])
        .when(kind == "observation", F.when(~block, "invalid_observation_event"))
        .otherwise(F.concat(F.lit("unknown_event_kind:"), F.coalesce(kind, F.lit("None"))))
    )


#: What the first two protocols tell the model.
TASK = "Answer the question using the search tool when needed. Reason inside <think>...</think>. To search, emit exactly <search>query</search>; after each search you will receive <information>...</information>. Finish with exactly <answer>final answer</answer>.\nQuestion: "
NOTHING_NEW = "No new information was retrieved. Use the available evidence to answer, or issue a different search query."
NOTHING_NEW_LAST = "No new information was retrieved. The search budget is exhausted. Use the available evidence and output the required answer tag now."
USE = "\nUse the evidence above."
GO_ON = " If the evidence answers the question, stop searching and output the required answer tag."
LAST = " This is the final allowed search; do not search again. Output the required answer tag now."


def question_message(question: Column) -> Column:
    return F.concat(F.lit(TASK), question)


def block(text: Column) -> Column:
    return F.concat(F.lit("<information>\n"), text, F.lit("\n</information>"))


def information_message(contents: Column, last: Column) -> Column:
    """The passages of one round, a blank line between them, in one block, and what the environment adds to it."""
    return F.concat(block(F.array_join(contents, "\n\n")), F.lit(USE), F.when(last, LAST).otherwise(GO_ON))


def repeat_message(last: Column) -> Column:
    """The answer to a query that was there before."""
    return block(F.when(last, NOTHING_NEW_LAST).otherwise(NOTHING_NEW))


def appended(events: Column) -> Column:
    """The trajectory of an array of event texts: each stripped, a blank line between them."""
    return F.array_join(F.transform(events, strip), "\n\n")
