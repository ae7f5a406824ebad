"""Encoders and rerankers of one's own: ``load()`` runs once a worker process, its result is called batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def encoder(load: Callable, batch: int = 128):
    """``load() -> f(texts) -> vectors`` as a Column function of normalised text, vectors at length 1."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for t in texts:
            parts = [v for i in range(0, len(t), batch) for v in model(t.iloc[i : i + batch].tolist())]
            yield pd.Series([[float(x) for x in v] for v in parts])

    from .dense import unit

    return lambda norm: F.transform(unit(encode(norm)), lambda x: x.cast("float"))


def reranker(load: Callable):
    """``load() -> f(pairs) -> scores`` as a Column over (q, text, score): pairs of the normalised question and the raw text.

    A batch whose model fails keeps the scores that it had.
    """
    from ..functions.text import norm_retrieval

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001  as the contract says: without a model the order stays
            model = None
        for q, t, s in batches:
            try:
                yield pd.Series([float(x) for x in model(list(zip(q, t)))])
            except Exception:  # noqa: BLE001
                yield s.astype(float)

    return score(norm_retrieval("q"), F.col("text"), F.col("score"))
