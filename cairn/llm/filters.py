"""A Bloom filter over 64-bit numbers, built by Spark and sent to every task. It thins what is looked at, never decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each number, and the most bits that a filter has (16 MB). Past that many numbers it lets more through, which costs work only.
BITS_EACH, MOST_BITS = 12, 1 << 27
_LEAST_BITS = 1 << 16
_ODD = (np.uint64(0x589965CC75374CC3), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        for m in _ODD:
            yield ((values * m) >> np.uint64(32)).astype(np.int64) & (bits - 1)

    @classmethod
    def of(cls, values: DataFrame) -> Filter:
        """From the only column of a DataFrame. What reaches the driver are words of the filter, no more than MOST_BITS / 64."""
        n = values.count()
        bits = _LEAST_BITS
        while bits < min(MOST_BITS, BITS_EACH * n):
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for places in cls._places(batch.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(words, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
            at = np.flatnonzero(words)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "bits"])

        words = np.zeros(bits // 64, np.uint64)
        rows = values.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for places in self._places(values, 64 * len(self.words)):
            out &= (self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out
