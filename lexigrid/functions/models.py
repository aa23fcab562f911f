"""Models that a caller brings: embeddings, tokens and spans, made in Arrow batches by whatever the caller loads on a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Texts that a model is given at once.
BATCH = 256


def applied(df: DataFrame, text: str, name: str, kind: str, load: Callable[[], Callable[[list[str]], list]], batch: int = BATCH) -> DataFrame:
    """The table with ``name``: what a model says of each text, of a SQL type ``kind``; null for a null text.

    ``load`` makes the model once for each task, and the model takes a list of at most ``batch`` texts.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].copy()
                there = part[text].notna().to_numpy()
                said = iter(model(part[text][there].tolist()) if there.any() else [])
                part[name] = pd.Series([next(said) if t else None for t in there], index=part.index, dtype=object)
                yield part

    return df.mapInPandas(run, schema)
