"""Window features after corrections: only the rows that a change can reach are computed again.

A changed row reaches itself and the ``reach`` rows behind it in its series. These rows are dirty; computing them
takes them and the ``reach`` rows in front of each. Series without a change are not read beyond their keys' join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import materialized
from panelcast.spec import PanelSpec


def dirty_rows(panel: DataFrame, changed: DataFrame, reach: int, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The rows of ``panel`` that recomputing needs, with ``_dirty`` where the result may differ.

    ``changed`` holds (entity, date) of rows that were put in, altered or taken out; one that is not in the panel
    any more counts as the row behind it. Of a series only its dates are numbered before rows are picked."""
    key = [spec.entity, spec.date]
    changes = changed.select(*key).where(F.col(spec.entity).isNotNull() & F.col(spec.date).isNotNull()).distinct()
    touched = changes.select(spec.entity).distinct()
    numbered = panel.join(touched, spec.entity, "left_semi").withColumn("_i", F.row_number().over(spec.window(panel)))
    # A change's place is one more than the number of rows before it.
    both = numbered.select(*key, F.lit(1).alias("_row")).unionByName(changes.withColumn("_row", F.lit(0)))
    earlier = Window.partitionBy(spec.entity).orderBy(spec.date, "_row").rowsBetween(Window.unboundedPreceding, -1)
    at = both.withColumn("_at", F.coalesce(F.sum("_row").over(earlier), F.lit(0)) + 1).where(F.col("_row") == 0)
    spread = F.explode(F.sequence(F.col("_at") - reach, F.col("_at") + reach)).alias("_i")
    near = at.select(spec.entity, spread, "_at").groupBy(spec.entity, "_i").agg(
        F.bool_or(F.col("_i") >= F.col("_at")).alias("_dirty"))
    return numbered.join(near, [spec.entity, "_i"]).drop("_i")


def refreshed(
    stored: DataFrame, panel: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], reach: int,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """``stored``, what ``build`` made of the panel before, as it would make it of the panel now.

    ``build`` adds columns from windows that reach at most ``reach`` rows back; it keeps ``_dirty`` and the rows."""
    key = [spec.entity, spec.date]
    near = dirty_rows(panel, changed, reach, spec)
    # Written once: it is both what is new and what goes.
    fresh = materialized(build(near).where("_dirty").select(*stored.columns), "fresh")
    gone = fresh.select(*key).unionByName(changed.select(*key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(fresh)
