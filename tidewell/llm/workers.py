"""Small helpers for Arrow steps: objects kept by a Python worker, and bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows whose texts a task holds as Python objects at once.
ROWS = 1024

_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, or what an earlier task of this worker made under ``key``; a few objects stay."""
    if key not in _KEPT:
        if len(_KEPT) >= 8:
            _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class BoundedCache(dict):
    """``cache[word]`` computes a missing value; back to what it was given when over ``limit`` entries are held."""

    def __init__(self, compute: Callable[[Any], Any], limit: int = 400_000, given: dict | None = None) -> None:
        super().__init__(given or {})
        self.compute, self.limit, self.given = compute, limit, given or {}

    def __missing__(self, word: Any) -> Any:
        value = self[word] = self.compute(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.update(self.given)


def map_texts(
    df: DataFrame, keep: list[str], text: str, added: StructType, step: Callable[[], Callable[[pa.RecordBatch, list], Iterator[list]]]
) -> DataFrame:
    """``keep`` columns of ``df`` and the columns ``added``, made from the texts batch by batch.

    ``step()`` is called once a task and returns ``f(kept columns, texts) -> arrays`` that yields
    lists of Arrow arrays, one for each column of the result. ``text`` may be a string field of a
    kept struct (``row.text``); it is then read from there and does not travel a second time.
    """
    outer, _, inner = text.partition(".")
    held = keep.index(outer) if inner and outer in keep else None
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(*columns) if held is not None else df.select(*columns, F.col(text).cast("string").alias("t"))
    schema = StructType([StructField(c, f.dataType) for c, f in zip(keep, rows.schema, strict=False)] + added.fields)
    names = schema.names

    def run(batches):
        work = step()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            own = [batch.column(i) for i in range(len(keep))]
            texts = own[held].field(inner) if held is not None else batch.column(len(keep))
            for arrays in work(own, texts.to_pylist()):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)
