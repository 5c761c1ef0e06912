"""Frames that state processors give back."""

from __future__ import annotations

import pandas as pd


def plain_text(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with text as objects, and a frame without rows all of objects.

    Arrow turns text that pandas keeps in Arrow form, and empty columns of another kind, into chunks, which Spark's
    struct columns cannot take.
    """
    if frame.empty:
        return frame.astype(object)
    return frame.astype({c: object for c, kind in frame.dtypes.items() if isinstance(kind, pd.StringDtype)})
