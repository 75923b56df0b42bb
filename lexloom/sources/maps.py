"""Edit maps, id mappings and token groups from JSON files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _object(spark: SparkSession, path: str) -> dict[str, Any]:
    held = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(held, dict):
        raise ValueError(f"{path} holds no JSON object")
    return held


def _strings(x: Any, name: str) -> list[str]:
    if not isinstance(x, list) or not all(isinstance(y, str) for y in x):
        raise ValueError(f"{name} is no list of strings")
    if len(set(x)) < len(x):
        raise ValueError(f"{name}: tokens repeat")
    return x


def _renames(x: Any) -> dict[str, str]:
    if not isinstance(x, dict) or not all(isinstance(y, str) for y in x.values()):
        raise ValueError("rename is no object of strings")
    return x


def read_token_map(spark: SparkSession, path: str) -> tuple[list[str], list[str], dict[str, str]]:
    """(delete, add, rename) of a token map; a token in two of them is an error."""
    held = _object(spark, path)
    delete, add, rename = _strings(held.get("delete", []), "delete"), _strings(held.get("add", []), "add"), _renames(held.get("rename", {}))
    for a, b in ((set(delete), set(add)), (set(delete), set(rename)), (set(add), set(rename))):
        if both := a & b:
            raise ValueError(f"tokens in two lists: {sorted(both)[:8]}")
    return delete, add, rename


def read_special_map(spark: SparkSession, path: str) -> tuple[list[str], dict[str, str]]:
    """(keep, rename) of a special-token map; a token in both is an error."""
    held = _object(spark, path)
    keep, rename = _strings(held.get("keep", []), "keep"), _renames(held.get("rename", {}))
    if both := set(keep) & set(rename):
        raise ValueError(f"both kept and renamed: {sorted(both)[:8]}")
    return keep, rename


def read_id_mapping(spark: SparkSession, path: str) -> dict[int, int]:
    """Old to new ids; keys are digits, values whole numbers that do not repeat."""
    held = _object(spark, path)
    if not all(k.isdigit() and isinstance(v, int) and not isinstance(v, bool) and v >= 0 for k, v in held.items()):
        raise ValueError(f"{path} maps something else than ids")
    if len(set(held.values())) < len(held):
        raise ValueError(f"{path} maps two ids to one")
    return {int(k): v for k, v in held.items()}


def read_initializers(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """What added tokens are made of: new ids to lists of old ids, none of them empty."""
    held = _object(spark, path)
    number = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    if not all(k.isdigit() and isinstance(v, list) and v and all(map(number, v)) for k, v in held.items()):
        raise ValueError(f"{path} holds something else than lists of ids")
    return {int(k): v for k, v in held.items()}


def read_token_groups(spark: SparkSession, path: str | None) -> dict[str, list]:
    """Lists of ids and tokens by name; no file: all empty."""
    names = ("original_token_ids", "added_token_ids", "requested_added_token_ids", "intermediate_added_token_ids", "special_token_ids", "added_tokens", "requested_added_tokens", "intermediate_added_tokens", "special_tokens")
    held = _object(spark, path) if path else {}
    for n in names:
        kind = int if n.endswith("_ids") else str
        if not all(isinstance(x, kind) and not isinstance(x, bool) for x in held.get(n, [])):
            raise ValueError(f"{n} holds other things than {kind.__name__}")
    return {n: list(held.get(n, [])) for n in names}
