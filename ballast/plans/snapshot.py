"""The minute snapshot: colours, blockades, works and incidents of one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.aggregates import edge_delay_window
from ballast.operators.blockades import blocked_segments
from ballast.operators.filters import active_closures
from ballast.operators.joins import to_edges, uncovered_closures
from ballast.sinks.documents import snapshot_items

DELAY_WINDOW_S, BLOCKADE_WINDOW_S = 1800, 5400


def minute_snapshot(seg_obs: DataFrame, cancels: DataFrame, passages: DataFrame, segment_edges: DataFrame, closures: DataFrame,
                    works: DataFrame, incidents: DataFrame, coverage: DataFrame, as_of: int, delay_window_s: int = DELAY_WINDOW_S,
                    blockade_window_s: int = BLOCKADE_WINDOW_S) -> DataFrame:
    """Lines of the snapshot. Baseline closures fill in where no notice speaks about the edge."""
    window = edge_delay_window(seg_obs, segment_edges, as_of, delay_window_s)
    blocked = to_edges(blocked_segments(cancels, passages, as_of, blockade_window_s), segment_edges).select("edge")
    plan = uncovered_closures(active_closures(closures, as_of), works.select("edge"))
    nothing = F.lit(None).cast("string")
    own = plan.select(F.lit("").alias("group_seq"), F.lit("plan").alias("src"), F.lit("closed").alias("sev"), nothing.alias("until"),
                      nothing.alias("txt"), "edge")
    return snapshot_items(coverage, window, incidents, blocked, own.unionByName(works.select(*own.columns)))
