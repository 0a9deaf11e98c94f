"""Prediction metrics over (label, output, latency_seconds) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import ACTIONS
from ..functions.text import INVALID, normalize_action


def action_eval(predictions: DataFrame) -> DataFrame:
    """Macro-F1 over the fixed actions, valid rate, Brier score and mean latency, in one pass.

    An unreadable output counts as its own class with confidence 0; an action that
    occurs nowhere scores 0.
    """
    n = normalize_action("output")
    rows = predictions.select(
        F.col("label"),
        F.when(n["action_valid"], n["action"]).otherwise(INVALID).alias("pred"),
        n["confidence"].alias("confidence"),
        n["action_valid"].alias("valid"),
        "latency_seconds",
    )
    hit = F.col("label") == F.col("pred")
    counts = []
    for a in ACTIONS:
        is_label, is_pred = F.col("label") == a, F.col("pred") == a
        counts += [
            F.count_if(is_label & is_pred).alias(f"tp_{a}"),
            F.count_if(~is_label & is_pred).alias(f"fp_{a}"),
            F.count_if(is_label & ~is_pred).alias(f"fn_{a}"),
        ]
    total = rows.agg(
        *counts,
        F.avg(F.col("valid").cast("double")).alias("json_valid_rate"),
        F.avg(F.pow(F.col("confidence") - hit.cast("double"), F.lit(2.0))).alias("brier_score"),
        F.avg("latency_seconds").alias("mean_inference_seconds"),
    )
    f1 = None
    for a in ACTIONS:
        tp, fp, fn = F.col(f"tp_{a}"), F.col(f"fp_{a}"), F.col(f"fn_{a}")
        # 2PR/(P+R) written with counts; 0 when the action never occurs
        score = F.coalesce(F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)), F.lit(0.0))
        f1 = score if f1 is None else f1 + score
    return total.select(
        (f1 / len(ACTIONS)).alias("action_macro_f1"), "json_valid_rate", "brier_score", "mean_inference_seconds"
    )
