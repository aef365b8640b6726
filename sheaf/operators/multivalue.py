"""Several values packed in one field: one row per value, with its place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import peg


def split_values(df: DataFrame, key: str, column: str, people: bool = False, errors: bool = False) -> DataFrame:
    """(record_id, pos, val, error_flag) for every single value of df[column]; key is carried as record_id.

    With errors also a row without val for each empty element and each 'et al', pos being the place of the value before it.

    Only the two columns are read; each Arrow batch is parsed on its own, so no shuffle is needed and
    a hot key or very long text stays within its batch. Null, blank or separator-only fields give no
    rows; repeated rows give repeated results (use distinct keys where that matters); extra columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[tuple[int, str | None, str]]] = {}
        for batch in batches:
            ids, pos, val, flag = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = memo.get(text)
                if got is None:
                    got = peg.elements(text, people) if errors else peg.parse(text, people)
                    if len(memo) < 4096:
                        memo[text] = got
                for p, v, f in got:
                    ids.append(k)
                    pos.append(p)
                    val.append(v)
                    flag.append(f or None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(val, pa.string()), pa.array(flag, pa.string())],
                ["record_id", "pos", "val", "error_flag"],
            )

    slim = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(column).cast("string").alias("v")).where(F.col("v").isNotNull())
    return slim.mapInArrow(run, "record_id bigint, pos int, val string, error_flag string")
