"""A function of one's own, applied record by record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def apply_records(records: DataFrame, function: Callable[[dict], dict], result: str) -> DataFrame:
    """The records with the columns of `result` (DDL) that the function gives for each, and `error`.

    A record on which the function fails keeps its row, with null results and the error's kind and text, so
    one bad record neither stops the others nor gets lost. Results replace columns of the same name. Runs in
    Arrow batches, each record by itself.
    """
    made = StructType.fromDDL(result)
    names = made.fieldNames()
    kept = [f for f in records.schema.fields if f.name not in (*names, "error")]
    schema = StructType([*kept, *made.fields]).add("error", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                try:
                    found = function(record)
                    rows.append([*(found.get(n) for n in names), None])
                except Exception as e:  # noqa: BLE001
                    rows.append([*(None for _ in names), f"{type(e).__name__}: {e}"])
            out = pd.DataFrame(rows, columns=[*names, "error"], index=frame.index, dtype=object)
            yield pd.concat([frame[[f.name for f in kept]], out], axis=1)

    return records.mapInPandas(run, schema)
