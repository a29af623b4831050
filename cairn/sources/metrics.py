"""Counters of frames that are written anyway, and the lines that runs log."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Counts rows while a frame is written: no second scan and no second job. on() belongs right before a write, in the job's last stage, where
    a row counts once however often its task is tried; in an earlier stage a lost executor's work would count again."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def on(self, df: DataFrame, **counts: Column) -> DataFrame:
        """df, with the rows counted for which each condition holds."""
        self._seen.append(Observation())
        return df.observe(self._seen[-1], *(F.count(F.when(c, F.lit(1))).alias(n) for n, c in counts.items()))

    def values(self) -> dict[str, int]:
        """All counters, after the frames have been written."""
        return {n: v for o in self._seen for n, v in o.get.items()}


def event_line(event: str, **fields: object) -> str:
    """An event with its fields by name; those without a value are left out."""
    return " ".join([f"event={event}", *(f"{k}={fields[k]}" for k in sorted(fields) if fields[k] is not None)])


def log_event(logger: logging.Logger, event: str, **fields: object) -> None:
    logger.info(event_line(event, **fields))
