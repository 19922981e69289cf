"""Results in a form that compares across engines."""

import pandas as pd


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.apply(lambda s: s.map(lambda v: None if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)
