"""Caller-given functions over many rows: batch text generation and mapping with captured errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

Predict = Callable[[list[str]], list[str]]


def generate(
    frame: DataFrame, make_predict: Callable[[], Predict], column: str = "input", batch: int = 32, output: str = "prediction"
) -> DataFrame:
    """Add the output of a text model.

    ``make_predict`` runs once per task and returns the model function, which maps a list of inputs to a
    list of outputs; this is where a caller loads weights.  A null input has a null output and is not given to the
    model.  All columns pass through Python, so select the needed ones first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for rows in batches:
            texts, out = rows[column].dropna(), []
            for i in range(0, len(texts), batch):
                out.extend(predict(texts.iloc[i : i + batch].tolist()))
            found = pd.Series(out, dtype=object, index=texts.index).reindex(rows.index)
            yield rows.assign(**{output: found.where(found.notna(), None)})

    schema = StructType([*frame.schema.fields, StructField(output, StringType())])
    return frame.mapInPandas(run, schema)


def template_model() -> Predict:
    """Stand-in for a model: says how many values of how many rows the input has."""

    def predict(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            rows = t.count("[X_SEP]") + (1 if "|" in t else 0)
            out.append(f"The table has {t.count(' | ')} values in {rows} rows .")
        return out

    return predict


def map_with_errors(frame: DataFrame, function: Callable[[dict], object], key: str) -> DataFrame:
    """``key, value, error``: the result of a function for each row as text, or the error it raised."""
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for record in rows.to_dict("records"):
                try:
                    out.append((record[key], str(function(record)), None))
                except Exception as e:  # noqa: BLE001 - any failure becomes the result of its row
                    out.append((record[key], None, type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "value", "error"])

    return frame.mapInPandas(run, f"key {kind}, value string, error string")
