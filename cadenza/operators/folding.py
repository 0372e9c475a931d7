"""Ordered folds in bounded memory: one key's rows pass a state machine batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


class Machine(Protocol):
    """The state of one key."""

    def push(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        """What follows from the next rows, in their order."""

    def close(self) -> pd.DataFrame | None:
        """What follows from the end of the key's rows."""


def folded(rows: DataFrame, key: str, order: list[str | Column], machine: Callable[[object], Machine], schema: str) -> DataFrame:
    """What a machine (made from the key's value) gives for each key's rows in order.

    Rows are dealt out by key and sorted by Spark, which spills; a task holds one Arrow batch and
    the state of one key, however many rows that key has. Null is a key of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Machine | None = None
        value = None
        for pdf in batches:
            if pdf.empty:
                continue
            keys, none = pdf[key].to_numpy(object), pdf[key].isna().to_numpy()
            cuts = [0, *(np.flatnonzero(((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) & ~(none[1:] & none[:-1])) + 1), len(pdf)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                new = None if none[i] else keys[i]
                if own is None or new != value:
                    if own is not None and (out := own.close()) is not None and len(out):
                        yield out
                    own, value = machine(new), new
                if (out := own.push(pdf.iloc[i:j].reset_index(drop=True))) is not None and len(out):
                    yield out
        if own is not None and (out := own.close()) is not None and len(out):
            yield out

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
