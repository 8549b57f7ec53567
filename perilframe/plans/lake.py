"""From lake tables to feature, training and risk tables, each as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode, exposure, hazard, portfolio, spatial


def gold_features(locations: DataFrame, grid: DataFrame, claims: DataFrame) -> DataFrame:
    """Locations with climate, claim history and coast distance.

    The grid is reduced per cell before the join, and the coast distance is a
    projection, so the only shuffles are on cell and on location.
    """
    climate = hazard.climate_by_cell(locations, grid)
    history = exposure.claim_history(claims)
    joined = locations.join(climate, "location_id", "left").join(history, "location_id", "left")
    return spatial.distance_to_coast(joined.na.fill(0, exposure.HISTORY))


def headline(locations: DataFrame, policies: DataFrame, tracks: DataFrame, n: int = 10) -> DataFrame:
    """The n costliest events to the insured book."""
    return hazard.top_events(hazard.event_losses(locations, policies, tracks), n)


def risk_book(
    locations: DataFrame, claims: DataFrame, scores: DataFrame, first_year: int, last_year: int
) -> DataFrame:
    """(location_id, tiv_usd, frequency, severity, multiplier): what a season model needs.

    ``scores`` is (location_id, score); a location without one keeps multiplier 1.
    """
    rated = encode.score_multiplier(scores, "score").select("location_id", "multiplier")
    return (
        locations.select("location_id", "tiv_usd")
        .join(portfolio.frequency_baseline(locations, claims, first_year, last_year), "location_id")
        .join(portfolio.severity_baseline(locations, claims), "location_id")
        .join(rated, "location_id", "left")
        .na.fill(1.0, ["multiplier"])
    )


def tail_risk(annual: DataFrame, book: DataFrame) -> DataFrame:
    """Tail metrics of a table of annual losses (season, annual_loss) against the insured value of the book: one row."""
    return portfolio.tail_metrics(annual, book.agg(F.sum("tiv_usd")).scalar())
