"""A filter of fixed size for keys: no key is missed, others rarely pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import map_arrow

#: 2 MB, however many keys there are; with very many it lets more rows pass.
BITS = 1 << 24


def bitset(keys: DataFrame, column: str) -> np.ndarray:
    """Bits at the remainders of the 64-bit keys; at most BITS / 64 rows come to the driver."""
    slot = F.pmod(F.col(column), F.lit(BITS)).cast("int")
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def only_keys(rows: DataFrame, column: str, bits: np.ndarray, among: bool = True) -> DataFrame:
    """Rows whose key may be among the keys of the bits, before a join that decides; or all others, which are surely not."""
    at = rows.columns.index(column)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = np.mod(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64), BITS)
        return batch.filter(pa.array((bits[slot >> 6] >> (slot & 63)) & 1 == int(among)))

    return map_arrow(rows, keep, rows.schema)
