"""Step programs: named calls and selections over tables, composed lazily.

A program is {"steps": [...], "return": id}. A step has an id and either ``call``
(the name of a registered query) or ``select`` with ``from``, and optionally
``pointer``, ``where`` {"equals": {...}}, ``fields`` and ``limit``. ``{"$ref": id}`` as
an argument stands for an earlier step's table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STEPS, MAX_CALLS, MAX_BYTES = 16, 8, 4_000_000


class ProgramError(ValueError):
    """The program breaks a rule of the language."""


def validate(program: dict) -> None:
    steps = program.get("steps") or []
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ProgramError(f"a program has 1 to {MAX_STEPS} steps")
    seen: set[str] = set()
    for s in steps:
        if not s.get("id") or s["id"] in seen:
            raise ProgramError("step ids are given once each")
        if ("call" in s) == ("select" in s):
            raise ProgramError("a step has either call or select")
        source = s["select"].get("from") if "select" in s else None
        if source is not None and source not in seen:
            raise ProgramError(f"{source} isn't an earlier step")
        for ref in _refs(s.get("arguments")):
            if ref not in seen:
                raise ProgramError(f"{ref} isn't an earlier step")
        seen.add(s["id"])
    if sum("call" in s for s in steps) > MAX_CALLS:
        raise ProgramError(f"at most {MAX_CALLS} calls")
    if program.get("return") not in seen:
        raise ProgramError("return names no step")


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        return [value["$ref"]] if "$ref" in value else [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _resolved(value, tables: dict[str, DataFrame]):
    if isinstance(value, dict):
        return tables[value["$ref"]] if "$ref" in value else {k: _resolved(v, tables) for k, v in value.items()}
    return [_resolved(v, tables) for v in value] if isinstance(value, list) else value


def select(df: DataFrame, spec: dict) -> DataFrame:
    """pointer, then where, then fields, then limit; without a limit, all rows."""
    for part in [p for p in (spec.get("pointer") or "").split("/") if p]:
        name = part.replace("~1", "/").replace("~0", "~")
        kind = dict(df.dtypes).get(name, "")
        df = df.select(F.explode(name).alias("_x")) if kind.startswith("array") else df.select(F.col(f"`{name}`").alias("_x"))
        if df.dtypes[0][1].startswith("struct"):
            df = df.select("_x.*")
    for column, value in ((spec.get("where") or {}).get("equals") or {}).items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    if spec.get("fields"):
        df = df.select(*spec["fields"])
    limit = spec.get("limit")
    if limit is None:
        return df
    if limit < 0:
        raise ProgramError("limit is 0 or more")
    return df.limit(limit)


def run(program: dict, calls: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """The table that the program returns; nothing runs until it is used."""
    validate(program)
    tables: dict[str, DataFrame] = {}
    for s in program["steps"]:
        if "call" in s:
            if s["call"] not in calls:
                raise ProgramError(f"no such call: {s['call']}")
            tables[s["id"]] = calls[s["call"]](**_resolved(s.get("arguments") or {}, tables))
        else:
            tables[s["id"]] = select(tables[s["select"]["from"]], s["select"])
    return tables[program["return"]]


def result_rows(df: DataFrame) -> list[str]:
    """Rows as JSON for a caller outside; more than MAX_BYTES is an error, found before anything is gathered."""
    size = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.coalesce(F.sum(F.octet_length("j")), F.lit(0))).first()[0]
    if size > MAX_BYTES:
        raise ProgramError(f"the result has {size} bytes, {MAX_BYTES} at most")
    return df.toJSON().collect()
