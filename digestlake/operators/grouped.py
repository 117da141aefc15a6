"""Python work on whole groups, many groups a call."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def on_whole_groups(rows: DataFrame, key: str, order: list[str], make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """make over frames that hold whole groups of key, sorted by key and order.

    A call for each group costs milliseconds; here a call takes all groups of an Arrow batch, and only the last one waits for the next batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            codes = pd.factorize(held[key], use_na_sentinel=False)[0]  # null keys are one group, as they are to Spark
            cut = int(np.argmax(codes == codes[-1])) if len(codes) else 0
            if cut:
                yield make(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield make(held)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
