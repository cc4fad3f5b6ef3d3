"""matchup: Spark-native analytics for paired-entity events.

Two sides meet at a point in time (a season and a period inside it). Each
meeting is enriched with each side's point-in-time history, labelled, cleaned
against a saved feature contract, modelled, calibrated, scored and published.

Every operator is a plain ``DataFrame -> DataFrame`` function parameterised by
column names, so they compose with ``DataFrame.transform``.
"""

from matchup.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
