"""Records of how a genealogy came about."""

from __future__ import annotations

import json
import platform
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from kinweave import __version__
from kinweave.functions.metadata import canonical_json
from kinweave.model import Genealogy


def record(command: str, parameters: dict | None = None) -> dict:
    """Software, parameters and environment of a step."""
    import pyspark

    return {
        "schema_version": "1.0.0", "software": {"name": "kinweave", "version": __version__}, "parameters": {"command": command} | (parameters or {}),
        "environment": {"os": {"system": platform.system(), "machine": platform.machine(), "release": platform.release()}, "python": {"implementation": platform.python_implementation(), "version": sys.version.split()[0]}, "libraries": {"spark": {"version": pyspark.__version__}}},
    }


def problems(value: dict) -> list[str]:
    """What keeps a record from being valid; empty for a valid one."""
    out = [f"{k} is missing" for k in ("schema_version", "software", "parameters", "environment") if k not in value]
    out += [f"software.{k} is missing" for k in ("name", "version") if k not in value.get("software", {})]
    return out


def with_record(g: Genealogy, command: str, parameters: dict | None = None) -> Genealogy:
    """The genealogy with a record of a step behind those it has."""
    top = g.provenances.agg(F.max("id")).first()[0]
    row = (0 if top is None else top + 1, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S"), canonical_json(record(command, parameters)))
    return g.with_tables(provenances=g.provenances.unionByName(g.spark.createDataFrame([row], "id long, timestamp string, record string")))


def records(g: Genealogy) -> list[dict]:
    return [json.loads(r["record"]) for r in g.provenances.orderBy("id").collect()]
