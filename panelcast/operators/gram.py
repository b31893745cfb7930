"""Correlations of many columns from blocked matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelcast.functions.sqltext import quoted
from panelcast.session import send_code
from panelcast.spec import present

send_code(__name__)

#: Columns whose rows of the matrix one task makes.
BLOCK_COLUMNS = 16


def wide_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, r) as ``reports.correlation_matrix`` gives it, for many columns: a plan of one size
    whatever their number.

    Rows travel as one array. A task keeps products, sums and counts over the rows complete in both columns of every
    pair as matrix products of its values and of their masks, around the columns' means, and hands them over by
    blocks of columns; a task for each block adds them up and gives its rows of the matrix."""
    names = present(df, columns)
    values = [f"nanvl(cast({quoted(c)} as double), null)" for c in names]
    wide = df.selectExpr(f"array({', '.join(values)}) as x")
    means = df.selectExpr(f"array({', '.join(f'avg({x})' for x in values)}) as m").first()[0]
    center = np.array([0.0 if m is None else m for m in means])

    def summed(frames):
        total = np.zeros((len(names), 6, len(names)))
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_list()).astype("f8") - center
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype("f8")
            # Products, then sums and squares of the one and of the other column, then counts.
            total += np.stack([x.T @ x, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), m.T @ m], 1)
        for at in range(0, len(names), BLOCK_COLUMNS):
            yield pd.DataFrame({"block": [at], "sums": [total[at:at + BLOCK_COLUMNS].tobytes()]})

    def matrix(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["block"].iloc[0])
        total = sum(np.frombuffer(b) for b in frame["sums"]).reshape(-1, 6, len(names))
        ab, a, b, aa, bb, n = total.transpose(1, 0, 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            ab, aa, bb = ab - a * b / n, aa - a * a / n, bb - b * b / n
            r = ab / (np.sqrt(aa) * np.sqrt(bb))
        # What rounding alone leaves of a constant column is no spread.
        least = n * 1e-24
        own = center[at:at + len(r), None]
        fine = (aa > least * (1 + own ** 2)) & (bb > least * (1 + center[None, :] ** 2))
        return pd.DataFrame({"column_a": np.repeat(names[at:at + len(r)], len(names)), "column_b": names * len(r),
                             "r": pd.Series(r.ravel()).where(fine.ravel()).astype(object).where(fine.ravel(), None)})

    parts = wide.mapInPandas(summed, "block int, sums binary")
    return parts.groupBy("block").applyInPandas(matrix, "column_a string, column_b string, r double")
