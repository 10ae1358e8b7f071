"""The binary key-array store of tree files: a header of 64 bytes, a descriptor of 64 bytes an item, the keys, then the arrays on multiples of 8 bytes."""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinweave.model import SCHEMAS, Genealogy, names

#: Fixed values of the format.
MAGIC = b"\x89KAS\r\n\x1a\n"
TYPES = ["int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64"]
UNKNOWN_TIME = np.uint64(0x7FF874736B697421)
FORMAT_VERSION = (12, 7)


def read_store(path: str) -> dict[str, np.ndarray]:
    """All arrays of a store by key."""
    raw = np.fromfile(path, dtype="uint8")
    if raw[:8].tobytes() != MAGIC:
        raise ValueError("not a key-array store")
    _, _, n, size = struct.unpack_from("<HHIQ", raw[8:24].tobytes())
    if size != len(raw):
        raise ValueError("the file is cut off or too long")
    out = {}
    for i in range(n):
        kind, _, ks, kl, as_, al = struct.unpack_from("<B7sQQQQ", raw[64 * (i + 1) : 64 * (i + 2)].tobytes())
        t = np.dtype(TYPES[kind])
        out[raw[ks : ks + kl].tobytes().decode()] = raw[as_ : as_ + al * t.itemsize].view(t) if al else np.array([], dtype=t)
    return out


def write_store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays in the order of their keys."""
    items = sorted(arrays.items(), key=lambda kv: kv[0].encode())
    keys = [k.encode() for k, _ in items]
    at = 64 * (len(items) + 1)
    starts = []
    for k in keys:
        starts.append(at)
        at += len(k)
    places = []
    for _, a in items:
        at += -at % 8
        places.append(at)
        at += a.nbytes
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<HHIQ", 1, 0, len(items), at) + b"\0" * 40)
        for (_, a), k, ks, p in zip(items, keys, starts, places):
            f.write(struct.pack("<B7sQQQQ", TYPES.index(str(a.dtype)), b"", ks, len(k), p, len(a)) + b"\0" * 24)
        for k in keys:
            f.write(k)
        for (_, a), p in zip(items, places):
            f.write(b"\0" * (p - f.tell()) + np.ascontiguousarray(a).tobytes())


_RAGGED = {"metadata": bytes, "ancestral_state": str, "derived_state": str, "location": float, "parents": int, "timestamp": str, "record": str}
_FIXED = {"flags": "uint32", "time": "float64", "left": "float64", "right": "float64", "position": "float64"}


def format_name(path: str) -> str:
    """The name a tree file gives its format."""
    return read_store(path)["format/name"].tobytes().rstrip(b"\0").decode()


def read_trees(spark: SparkSession, path: str, name: str | None = None, skip_tables: bool = False) -> Genealogy:
    """A genealogy from one tree file, which a single machine must be able to hold. Files whose format has another ``name``, if one is given, are refused.

    With ``skip_tables`` only the sequence length, time units and empty tables come.
    """
    s = read_store(path)
    if "format/name" not in s or s["format/version"][0] != FORMAT_VERSION[0] or name is not None and s["format/name"].tobytes().rstrip(b"\0").decode() != name:
        raise ValueError("not a tree file of a known version")
    tables = {}
    for t, schema in SCHEMAS.items():
        if skip_tables:
            tables[t] = spark.createDataFrame([], schema)
            continue
        cols = names(t)[1:]
        n = next((len(s[f"{t}/{c}"]) for c in cols if c not in _RAGGED), None)
        n = len(s[f"{t}/{cols[-1]}_offset"]) - 1 if n is None else n
        data: dict[str, list] = {"id": list(range(n))}
        for c in cols:
            a = s.get(f"{t}/{c}")
            if c in _RAGGED:
                off = s[f"{t}/{c}_offset"].astype("int64") if f"{t}/{c}_offset" in s else np.zeros(n + 1, "int64")
                kind = _RAGGED[c]
                parts = [a[off[i] : off[i + 1]] for i in range(n)]
                data[c] = [p.tobytes() if kind is bytes else p.tobytes().decode() if kind is str else [kind(x) for x in p] for p in parts]
            elif c == "time":
                unknown = a.view("uint64") == UNKNOWN_TIME
                data[c] = [None if u else float(x) for x, u in zip(a, unknown)]
            else:
                data[c] = a.astype("float64" if _FIXED.get(c) == "float64" else "int64").tolist()
        tables[t] = spark.createDataFrame(list(zip(*[data[c] for c in names(t)])), schema)
    return Genealogy(**tables, sequence_length=float(s["sequence_length"][0]), time_units=s["time_units"].tobytes().decode() if "time_units" in s else "unknown")


def write_trees(g: Genealogy, path: str, name: str) -> None:
    """Write one tree file whose format is called ``name`` (readers compare it; :func:`format_name` gives that of a file); the tables are collected, as the format is one file of arrays."""
    from kinweave.operators.transforms import sort

    out: dict[str, np.ndarray] = {
        "format/name": np.frombuffer(name.encode(), "int8"), "format/version": np.array(FORMAT_VERSION, "uint32"), "sequence_length": np.array([g.sequence_length]),
        "uuid": np.frombuffer(str(uuid.uuid4()).encode(), "int8"), "time_units": np.frombuffer(g.time_units.encode(), "int8"), "metadata": np.frombuffer(json.dumps(g.metadata).encode() if g.metadata else b"", "int8"), "metadata_schema": np.array([], "int8"),
    }
    g = sort(g)
    for t in SCHEMAS:
        pdf: pd.DataFrame = getattr(g, t).select(*names(t)).orderBy("id").toPandas()
        if pdf["id"].tolist() != list(range(len(pdf))):
            raise ValueError(f"ids of {t} must be 0, 1, ..")
        for c in names(t)[1:]:
            v = pdf[c].tolist()
            if c in _RAGGED:
                kind = _RAGGED[c]
                parts = [np.frombuffer((x or b"") if kind is bytes else (x or "").encode(), "int8") if kind in (bytes, str) else np.array(x if x is not None else [], "float64" if kind is float else "int32") for x in v]
                out[f"{t}/{c}"] = np.concatenate(parts) if parts else np.array([], "int8" if kind in (bytes, str) else "float64" if kind is float else "int32")
                out[f"{t}/{c}_offset"] = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("uint32")
            elif c == "time":
                a = np.array([np.nan if x is None else x for x in v], dtype="float64")
                a.view("uint64")[np.array([x is None or x != x for x in v], dtype=bool)] = UNKNOWN_TIME
                out[f"{t}/{c}"] = a
            else:
                out[f"{t}/{c}"] = np.array(v, dtype=_FIXED.get(c, "int32"))
        if t != "provenances":
            out[f"{t}/metadata_schema"] = np.array([], "int8")
    e = g.edges.join(g.nodes.select(F.col("id").alias("parent"), "time"), "parent").select("id", "left", "right", "time", "parent", "child").toPandas().sort_values("id")
    if len(e):
        out["indexes/edge_insertion_order"] = np.lexsort((e["child"], e["parent"], e["time"], e["left"])).astype("int32")
        out["indexes/edge_removal_order"] = np.lexsort((-e["child"], -e["parent"], -e["time"], e["right"])).astype("int32")
    write_store(path, out)
