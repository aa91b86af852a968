"""Checks of generated explanations, one row per text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def check_explanations(
    df: DataFrame,
    text: str = "explanation",
    prompt: str = "prompt",
    outcomes: Column | None = None,
) -> DataFrame:
    """Add the invented numbers, forecast leaks, confusions with history and readability."""
    if outcomes is None:
        outcomes = F.array("historical_outcome.close_ret", "historical_outcome.high_ret")
    body = F.col(text)
    return df.withColumns(
        {
            "unmatched_numbers": T.unmatched_numbers(body, F.col(prompt)),
            "forecast_leaks": T.forecast_leaks(body),
            "historical_confusions": T.historical_confusions(body, outcomes),
            **T.readability(body),
        }
    )


CHECKS = {
    "faithful": "unmatched_numbers",
    "no_leak": "forecast_leaks",
    "no_confusion": "historical_confusions",
}


def advice_summary(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Passed texts and pass rate per check, and the mean readability."""
    passed = {name: (F.size(column) == 0) for name, column in CHECKS.items()}
    return checked.groupBy(*keys).agg(
        F.count("*").alias("texts"),
        *[F.count_if(ok).alias(f"n_{name}") for name, ok in passed.items()],
        *[F.avg(ok.cast("double")).alias(f"{name}_rate") for name, ok in passed.items()],
        F.avg("flesch_reading_ease").alias("mean_reading_ease"),
        F.avg("flesch_kincaid_grade").alias("mean_grade"),
    )


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Each assistant turn beside the user turn right before it.

    An equality join on (conversation, turn), so a conversation of any length is spread out.
    """
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    replies = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("explanation")
    )
    return replies.join(asked, ["conv_id", "turn"])
