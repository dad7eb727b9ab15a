"""Stateful stream operators that take a key's rows in arrival order, in bounded memory.

Rows of one trigger come to a key in any order, batch by batch. One batch is sorted as it is. Of several, the rows
are put into the state store by slices of ``seq`` as they come, and taken out again slice by slice: memory holds
one batch or one slice, however much has piled up, and the store spills to disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """These operators need the RocksDB state store; set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _bytes(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False, nthreads=1)  # small: threads cost more
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _rows(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas(use_threads=False)


class InOrder(StatefulProcessor):
    """A processor whose ``take`` gets the rows of a key in order of ``seq``, some at a time."""

    def __init__(self, slice_size: int):
        self.slice_size = slice_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spool = handle.getMapState("spool", "slice bigint, part int", "rows binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Makes the state variables."""

    def load(self, key: tuple) -> None:
        """Reads the key's state."""

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The next rows; what they give."""
        raise NotImplementedError

    def save(self, key: tuple) -> Iterator[pd.DataFrame]:
        """Writes the key's state after a trigger; what it gives at its end."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = iter(rows)
        first, second = next(rows, None), next(rows, None)
        if first is None:
            return
        self.load(key)
        if second is None:
            yield from self.take(key, first.sort_values("seq", kind="stable"))
        else:
            for part in self._sliced(chain((first, second), rows)):
                yield from self.take(key, part)
        yield from self.save(key)

    def _sliced(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = []
        for batch in batches:
            for number, part in batch.groupby(batch["seq"] // self.slice_size):
                keys.append((int(number), len(keys)))
                self.spool.updateValue(keys[-1], (_bytes(part),))
        for _, own in groupby(sorted(keys), key=lambda k: k[0]):
            parts = []
            for k in own:
                parts.append(_rows(bytes(self.spool.getValue(k)[0])))
                self.spool.removeKey(k)
            yield pd.concat(parts).sort_values("seq", kind="stable")

    def close(self) -> None:
        pass
