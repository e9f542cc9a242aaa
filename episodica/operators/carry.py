"""Where an episode of the first protocol goes on in the second: its state, read back from the transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, text
from .transfer import affected, classified

#: The environment's blocks stand on lines of their own; tags inside a model's sentences are no blocks.
BLOCK = r"(?ims)^<information>\n.*?^</information>"
ATTEMPTS = 8


def carried(rows: DataFrame) -> DataFrame:
    """Rows of the first protocol with ``origin`` (v1_continued, or v1_rerun where the state cannot be read back), ``error``
    (why not) and the state: ``last_action`` and ``last_observation`` of the last search that succeeded, ``next_action`` and
    ``next_observation`` of a repeat after it, ``final_only``, ``repeated``, ``stalled`` and ``seen`` (document keys).

    ``rows``: termination_reason, assistant (the transcript), queries, search_count, search_attempt_count, invalid_reasons
    and doc_ids (of all rounds, in order); other columns stay. Nulls are empty or 0.
    """
    strings = F.array().cast("array<string>")
    t, reasons = F.coalesce("assistant", F.lit("")), classified(F.col("invalid_reasons"))
    r = rows.withColumn("_blocks", F.regexp_extract_all(t, F.lit(f"({BLOCK})"), F.lit(1))).withColumn("_parts", F.split(t, BLOCK, -1))
    n = F.size("_blocks")
    r = r.withColumns({"_said": text.strip(F.get("_parts", n - 1)), "_then": text.strip(F.get("_parts", n)), "_block": F.get("_blocks", n - 1), "_reasons": reasons})
    r = r.withColumns({"_action": text.loose_action(F.col("_said")), "_again": text.loose_action(F.col("_then"))})
    ids, attempts = F.coalesce("doc_ids", strings), F.coalesce("search_attempt_count", F.lit(0))
    repeat = F.col("termination_reason") == "repeated_search"
    asked = F.transform(F.coalesce("queries", strings), text.normalize)
    no_search = lambda a: ~F.coalesce(F.col(f"{a}.kind") == "search", F.lit(False))
    error = (
        F.when(~affected(F.col("termination_reason")), "not_affected")
        .when(n == 0, "no_information_block")
        .when(no_search("_action"), "no_latest_search_action")
        .when(F.exists(ids, lambda x: F.coalesce(x, F.lit("")) == ""), "missing_document_identity")
        .when(F.size("_reasons.terminal") > 0, "terminal_reasons")
        .when(repeat & no_search("_again"), "no_repeated_search_action")
        .when(repeat & ~F.array_contains(asked, text.normalize(F.coalesce("_again.content", F.lit("")))), "repeat_not_in_history")
        .when(~repeat & (attempts != ATTEMPTS), "attempts_not_spent")
    )
    ok = F.col("error").isNull()
    last = F.when(repeat, F.coalesce("search_count", F.lit(0)) >= ATTEMPTS).otherwise(True)
    keep = lambda c: F.when(ok, c)
    r = r.withColumn("error", error).withColumns({
        "origin": F.when(ok, "v1_continued").otherwise("v1_rerun"),
        "last_action": keep(F.col("_said")),
        "last_observation": keep(F.concat("_block", F.lit(prompts.USE), F.when(last, prompts.LAST).otherwise(prompts.GO_ON))),
        "next_action": keep(F.when(repeat, F.col("_then"))),
        "next_observation": keep(F.when(repeat, prompts.repeat_message(attempts >= ATTEMPTS))),
        "final_only": keep(~repeat | (attempts >= ATTEMPTS)),
        "repeated": keep(F.size(F.filter("_reasons.recoverable", lambda x: x == "repeated_search_query"))),
        "stalled": keep(F.size("_reasons.recoverable")),
        "seen": keep(F.array_distinct(F.transform(ids, lambda x: F.concat(F.lit("id:"), x)))),
    })
    return r.drop("_blocks", "_parts", "_said", "_then", "_block", "_reasons", "_action", "_again")
