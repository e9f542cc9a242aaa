"""Results of the first protocol that the second takes over as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .replay import RECOVERABLE

#: Endings of the first protocol that the second changes, and the reason that it does not count.
CHANGED = ("repeated_search", "max_rounds")
IGNORED = "max_rounds_without_answer"


def classified(reasons: Column) -> Column:
    """struct(recoverable, terminal) of an array of reasons, each in its order; null is no reason."""
    known = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != IGNORED))
    return F.struct(F.filter(known, lambda r: r.isin(*RECOVERABLE)).alias("recoverable"), F.filter(known, lambda r: ~r.isin(*RECOVERABLE)).alias("terminal"))


def affected(termination: Column) -> Column:
    """The episode has to be continued or run again; all others are taken over."""
    return F.coalesce(termination.isin(*CHANGED), F.lit(False))


def taken_over(results: DataFrame) -> DataFrame:
    """Derives the flags of the second protocol again and sets all differences to the first to zero.

    ``results``: prediction, exact_match, f1, format_compliant, invalid_reasons, search_count,
    search_attempt_count, termination_reason; other columns stay. Nulls count as empty, 0 or false.
    """
    c = classified(F.col("invalid_reasons"))
    r = results.withColumns({"recoverable_reasons": c["recoverable"], "terminal_reasons": c["terminal"]})
    r = r.withColumns({"recoverable_violation": F.size("recoverable_reasons") > 0, "terminal_invalid": F.size("terminal_reasons") > 0})
    present = F.coalesce(F.col("prediction") != "", F.lit(False))
    hit = F.coalesce(F.col("exact_match").cast("int") != 0, F.lit(False))
    valid = present & F.coalesce("format_compliant", F.lit(False)) & ~F.col("terminal_invalid")
    strict = valid & ~F.col("recoverable_violation")
    zero = lambda name, kind: F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind))
    return r.withColumns({
        "origin": F.lit("v0_reused"),
        "has_any_violation": F.col("recoverable_violation") | F.col("terminal_invalid"),
        "invalid_tool_call": F.col("terminal_invalid"),
        "valid_trajectory": valid,
        "strict_trajectory": strict,
        "strict_success": hit & strict,
        "recovered_success": hit & present & F.col("recoverable_violation") & ~F.col("terminal_invalid"),
        "final_answer_opportunity": F.lit(False),
        "v0_exact_match": zero("exact_match", "int"),
        "v0_f1": zero("f1", "double"),
        "v0_search_count": zero("search_count", "int"),
        "v0_search_attempt_count": zero("search_attempt_count", "int"),
        "v0_termination_reason": F.col("termination_reason"),
        "exact_match_delta_vs_v0": F.lit(0),
        "f1_delta_vs_v0": F.lit(0.0),
        "search_count_delta_vs_v0": F.lit(0),
        "search_attempt_count_delta_vs_v0": F.lit(0),
    })
