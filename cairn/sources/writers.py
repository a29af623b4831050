"""Writers of audits and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_audit(df: DataFrame, path: str, form: str = "json") -> None:
    """An audit as JSON lines or CSV; in CSV lists are joined by | and maps and structs are JSON."""
    if form == "json":
        df.write.json(path)
        return
    flat = [F.array_join(c, "|").alias(c) if t == "array<string>" else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def report(title: str, rows: DataFrame, most: int = 500) -> str:
    """A small result as Markdown. At most `most` rows reach the driver; a report of more says so."""
    found = rows.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(str(v).replace("|", "/") for v in r) + " |" for r in found[:most]]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(found) > most else [])) + "\n"


def report_json(rows: DataFrame, most: int = 500) -> str:
    """A small result as JSON: rows, and whether there are more than the `most` that reach the driver."""
    found = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    return json.dumps({"rows": found[:most], "more": len(found) > most}, default=str, indent=2, sort_keys=True)
