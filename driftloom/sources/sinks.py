"""Reports and data sets as JSON, JSON lines and text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def as_json(reports: DataFrame) -> DataFrame:
    """run_id and the report as one JSON value; nulls are kept."""
    return reports.select("run_id", F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"))


def write_json(reports: DataFrame, path: str) -> None:
    as_json(reports).select("report").write.mode("overwrite").text(path)


def report_json(report: Row, indent: int = 2) -> str:
    return json.dumps(report.asDict(recursive=True), indent=indent, ensure_ascii=False)


def export_splits(path: str, **splits: DataFrame) -> None:
    """One folder of JSON lines a split; each is written by all its tasks."""
    for name, rows in splits.items():
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def _value(v) -> str:
    """A value on one line: numbers to three places, nothing as a dash."""
    if v is None or v == []:
        return "-"
    if isinstance(v, float):
        return f"{v:.3f}"
    if isinstance(v, list):
        return "; ".join(map(_value, v))
    if isinstance(v, dict):
        return ", ".join(f"{k}={_value(x)}" for k, x in v.items() if x is not None)
    return str(v)


def report_text(report: Row) -> str:
    """A report for people: its fields in the order of the schema, lists of records item by item."""
    out = []
    for name, value in report.asDict(recursive=True).items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            out += [f"{name}:", *[f"  {n}. {_value({k: v for k, v in item.items() if v not in ([], None)})}" for n, item in enumerate(value, 1)]]
        else:
            out.append(f"{name}: {_value(value)}")
    return "\n".join(out)
