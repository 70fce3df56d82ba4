"""Rank metrics of results against documented incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, REPORT_CAVEAT, AuditConfig
from ..functions import round_even
from ..runtime import materialize
from ..operators.ranking import (
    documented_absent, documented_names, precision_recall_at, roc_auc, suspicion_rank, upper_median,
)

SCORES = ("bot_pct", "confidence")
KS = (10, 25, 50)


def positive_ranks(ranked: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rank rows of the documented names that occur in the results."""
    names = documented_names(incidents)
    return ranked.join(names, "_norm").select(
        F.col("_norm").alias("artist"), "rank", round_even(F.col("percentile"), 1).alias("percentile"),
        "bot_pct", "confidence")


def evaluate_documented(results: DataFrame, incidents: DataFrame, score: str = "bot_pct",
                        cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One report row. The positives are as many as the incident table has names, which is small."""
    if score not in SCORES:
        raise ValueError(f"score must be one of {SCORES}, not {score!r}")
    ranked = materialize(suspicion_rank(results, score, cfg), "ranked")
    n = ranked.select(F.count("*").alias("n"))
    names = documented_names(incidents)
    positives = positive_ranks(ranked, incidents)
    marked = ranked.join(names.withColumn("_doc", F.lit(1)), "_norm", "left")
    auc = roc_auc(marked, F.col("_doc").isNotNull(), F.col(score))
    total = F.col("n_artists")
    metrics = positives.withColumn("n_artists", n.scalar()).agg(
        F.count("rank").alias("documented_present"),
        *precision_recall_at(positives, total, KS),
        upper_median(F.collect_list("percentile")).alias("median_percentile_of_positives"),
        F.array_sort(F.collect_list(F.struct("artist", "rank", "percentile", "bot_pct", "confidence")))
        .alias("positives"))
    absent = documented_absent(ranked, incidents).agg(F.array_sort(F.collect_list("artist")))
    out = metrics.withColumns({
        "caveat": F.lit(REPORT_CAVEAT), "score_col": F.lit(score), "n_artists": n.scalar(),
        "documented_verified": names.select(F.count("*")).scalar(),
        "documented_absent": absent.scalar(), "roc_auc": auc.scalar()})
    # without any positive there is no row to take the table size from; the precision is then 0 of min(k, n)
    for k in KS:
        name = f"precision_at_{k}"
        out = out.withColumn(name, F.when(total > 0, F.coalesce(name, F.lit(0.0))))
        out = out.withColumn(f"recall_at_{k}", F.when(total > 0, F.col(f"recall_at_{k}")))
    return out.select("caveat", "score_col", "n_artists", "documented_verified", "documented_present",
                      "documented_absent", *[f"{m}_at_{k}" for k in KS for m in ("precision", "recall")],
                      "median_percentile_of_positives", "roc_auc", "positives")
