"""Looking at tables: first rows, schema, row counts."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.operators.ordering import OrderBy
from weftline.operators.sampling import sample_first
from weftline.types import logical_name

PREVIEW_ROWS = 1_000


@dataclass(frozen=True)
class Preview:
    schema: list[tuple[str, str]]
    sample: DataFrame


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: OrderBy | None = None) -> Preview:
    """Logical schema and the first `n` rows: any rows, or the first in `order_by`."""
    schema = [(f.name, logical_name(f.dataType)) for f in df.schema.fields]
    return Preview(schema, sample_first(df, n, order_by) if order_by else df.limit(n))


class StepCounts:
    """Row counts of pipeline steps, gathered while the sink's job runs.

    >>> counts = StepCounts()
    >>> out = counts.watch("kept", df.where("x > 0"))
    >>> out.write.parquet(path)
    >>> counts.rows()
    {'kept': 10}
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        if name in self._seen:
            raise ValueError(f"step {name!r} is watched already")
        self._seen[name] = Observation()
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """Counts per step; waits for the first action over each step."""
        return {name: seen.get["rows"] for name, seen in self._seen.items()}
