"""Descriptions of callables, as data: name, short description, parameters."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

REGISTRY_SCHEMA = "name string, description string, parameters array<struct<pos:int,param:string,type:string,default:string,param_description:string>>"

_PARAM = re.compile(r"^\s*:param\s+(?:[\w\[\], .]+\s+)?(\w+)\s*:\s*(.*)$|^\s{2,}(\w+)\s*(?:\([^)]*\))?\s*:\s+(.*)$")


def _docs(fn: Callable) -> tuple[str, list[str]]:
    """Short description and the parameter descriptions in the order written."""
    lines = (inspect.getdoc(fn) or "").splitlines()
    short = []
    for x in lines:
        if not x.strip():
            break
        if _PARAM.match(x):
            break
        short.append(x.strip())
    params, inside = [], False
    for x in lines:
        if re.match(r"^(Args|Arguments|Parameters):\s*$", x.strip()):
            inside = True
        elif re.match(r"^(Returns|Raises|Yields):", x.strip()):
            inside = False
        elif (m := _PARAM.match(x)) and (m.group(1) or inside):
            params.append((m.group(2) or m.group(4) or "").strip())
    return " ".join(short), params


def describe(fn: Callable) -> tuple:
    """A registry row. Descriptions belong to parameters by position; what is missing reads ``None``."""
    short, docs = _docs(fn)
    params = []
    for i, p in enumerate(inspect.signature(fn).parameters.values()):
        default = "None" if p.default is inspect.Parameter.empty else json.dumps(p.default)
        params.append((i, p.name, str(p.annotation), default, docs[i] if i < len(docs) else "None"))
    return fn.__name__, short or "None", params


def registry(spark: SparkSession, functions: Iterable[Callable]) -> DataFrame:
    """One row per callable; meant to be joined with the names that replies choose."""
    return spark.createDataFrame([describe(f) for f in functions], REGISTRY_SCHEMA)


def schema_text(functions: Iterable[Callable]) -> str:
    """The registry as one JSON object, for a prompt."""
    out = {}
    for name, short, params in map(describe, functions):
        out[name] = {"description": short, "parameters": {p: {"type": t, "default value": d, "description": s} for _, p, t, d, s in params}}
    return json.dumps(out)
