"""Sets of hashes as bits of one size, whatever their number: nothing in the set is missed, and what passes by chance is told apart later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A set of bits (a power of two), those that the 64-bit hashes h of the rows fall on. Tasks put together chunks of it, so that the driver gets bits / 8 bytes."""
    chunk = min(19, bits.bit_length() - 1)  # bits of a place within its chunk

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            places = np.unique(b.column(0).to_numpy())
            for k in np.unique(places >> chunk).tolist():
                bit = np.zeros(1 << chunk, bool)
                bit[places[places >> chunk == k] & ((1 << chunk) - 1)] = True
                packed = np.packbits(bit, bitorder="little")
                made[k] = made[k] | packed if k in made else packed
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([v.tobytes() for v in made.values()], pa.binary())], ["k", "v"])

    place = hashes.select(F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1)).alias("p"))
    out = np.zeros((bits >> chunk, (1 << chunk) // 8), np.uint8)
    for r in place.repartition(F.shiftright("p", chunk)).mapInArrow(pack, "k long, v binary").toLocalIterator():
        out[r["k"]] |= np.frombuffer(r["v"], np.uint8)
    return out.ravel()


def in_filter(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - ((len(filter_) * 8).bit_length() - 1))
    return (filter_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
