"""The whole analysis of one table: profile, quality, metrics and insights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewise.operators import metrics
from tablewise.operators.profile import Profile, profile_table
from tablewise.operators.quality import check_quality


@dataclass
class Analysis:
    profile: Profile
    quality: DataFrame
    kpis: DataFrame
    measures: DataFrame
    date_ranges: DataFrame
    insights: DataFrame
    candidate_dimensions: list[str]
    candidate_measures: list[str]


def analyze(df: DataFrame, name: str = "table") -> Analysis:
    """Every number of the analysis. A derived source is best ``materialise``d first."""
    profile = profile_table(df, name)
    quality = check_quality(df, profile)
    return Analysis(
        profile=profile,
        quality=quality,
        kpis=metrics.suggest_kpis(df, profile),
        measures=metrics.measure_stats(profile),
        date_ranges=metrics.date_ranges(profile),
        insights=metrics.generate_insights(df, profile, quality),
        candidate_dimensions=metrics.candidate_dimensions(profile),
        candidate_measures=profile.measures,
    )
