"""Batches that go back to Spark."""

from __future__ import annotations

import pandas as pd


def batch(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as columns of plain objects: a dtype that pandas guesses, for strings above all, may come in chunks that Arrow refuses."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, values)}, columns=columns)
