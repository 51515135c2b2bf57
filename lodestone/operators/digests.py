"""Digests over the sorted rows of a group, byte for byte those of the joined text, without a row that holds the group.

The rows of a group come to one task in their order and are hashed one after the other; a SHA-256 can't be put together from parts, so that task is as long as
its group, but its memory is a batch's."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_sha256(rows: DataFrame, key: str, order: Sequence[str], text: Column) -> DataFrame:
    """``key``, ``digest``: the SHA-256, in hex, of the texts of a key one after the other in ``order``; null texts are left out, a null key is a key."""
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key), *(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), F.encode(text, "UTF-8").alias("_text")).filter("_text is not null")
    dealt = asked.repartition(key).sortWithinPartitions(key, *(f"_{k}" for k in range(len(order)))).select(key, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        name, state, of = none, None, None
        for batch in batches:
            names, digests = [], []
            of = batch.schema.field(0).type
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is none or own != name:
                    if state is not None:
                        names.append(name)
                        digests.append(state.hexdigest())
                    name, state = own, hashlib.sha256()
                state.update(data.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, of), pa.array(digests, pa.string())], names=[key, "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], of), pa.array([state.hexdigest()], pa.string())], names=[key, "digest"])

    return dealt.mapInArrow(run, f"`{key}` {kind}, digest string")
