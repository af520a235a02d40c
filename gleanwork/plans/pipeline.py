"""Steps with inputs, outputs and done marks: a plan is checked before anything runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.sources.files import filesystem


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


def ordered(steps: Iterable[Step]) -> list[Step]:
    """Steps so that each comes after what it needs; refuses repeats, unknown needs and circles, naming them."""
    by = {}
    for s in steps:
        if s.name in by:
            raise ValueError(f"step {s.name} is there twice")
        by[s.name] = s
    if missing := sorted({f"{s.name} needs {n}" for s in by.values() for n in s.needs if n not in by}):
        raise ValueError("; ".join(missing))
    out, left = [], dict(by)
    while left:
        free = [s for s in left.values() if not any(n in left for n in s.needs)]
        if not free:
            raise ValueError("these steps need each other: " + ", ".join(sorted(left)))
        out += free
        for s in free:
            del left[s.name]
    return out


def from_config(config: dict, known: dict[str, set[str]]) -> list[Step]:
    """Steps of ``{"steps": {name: {"kind": .., "needs": [..], **params}}}``; kinds and parameters must be known."""
    steps = []
    for name, c in (config.get("steps") or {}).items():
        kind = c.get("kind")
        if kind not in known:
            raise ValueError(f"{name}: no kind {kind}")
        params = {k: v for k, v in c.items() if k not in ("kind", "needs")}
        if extra := sorted(set(params) - known[kind]):
            raise ValueError(f"{name}: {kind} has no {', '.join(extra)}")
        steps.append(Step(name, tuple(c.get("needs") or ()), {"kind": kind, **params}))
    return ordered(steps)


def run(steps: list[Step], folder: str | Path, act: Callable[[Step, str], dict | None], start: str | None = None, force: bool = False) -> dict[str, str]:
    """Runs the steps that lack a done mark for their parameters; ``start`` runs that one and all after it again.

    A mark is written after its step, so that a run that broke off goes on where it stopped. ``folder`` may be an
    address in a shared file system; a step gets its own folder in it.
    """
    at, base = filesystem(str(folder))
    said, again = {}, force
    for s in steps:
        again |= s.name == start
        own, key = f"{base}/{s.name}", {"params": s.params, "needs": list(s.needs)}
        mark = f"{own}/done.json"
        if not again and _mark(at, mark).get("key") == json.loads(json.dumps(key)) and all(said[n] == "kept" for n in s.needs):
            said[s.name] = "kept"
            continue
        at.create_dir(own, recursive=True)
        if at.get_file_info(mark).type == fs.FileType.File:
            at.delete_file(mark)
        result = act(s, f"{str(folder).rstrip('/')}/{s.name}")
        with at.open_output_stream(f"{mark}.part") as f:
            f.write(json.dumps({"key": key, "result": result}).encode())
        at.move(f"{mark}.part", mark)
        said[s.name] = "ran"
    return said


def _mark(at, mark: str) -> dict:
    if at.get_file_info(mark).type != fs.FileType.File:
        return {}
    with at.open_input_stream(mark) as f:
        return json.loads(f.read())


def stage_files(spark: SparkSession, config: dict, roles: tuple[str, ...] = ("train", "eval", "calibration")) -> DataFrame:
    """(path, role, stage): every file that the steps of a configuration name under one of ``roles``, a text or a list each."""
    rows = []
    for name, c in (config.get("steps") or {}).items():
        for role in roles:
            given = c.get(role) or []
            rows += [(p, role, name) for p in ([given] if isinstance(given, str) else given)]
    return spark.createDataFrame(rows, "path string, role string, stage string")


def kept_table(spark: SparkSession, folder: str, sources: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written under ``folder`` once per signature of ``sources`` (path, length, sha256) and read again
    as long as they are the same; a part of it left by a run that broke off is written anew."""
    sign = sources.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "path", "length", "sha256")))), 256).alias("s")).first().s[:16]  # a row per source file
    at, base = filesystem(folder)
    if at.get_file_info(f"{base}/{sign}/_SUCCESS").type != fs.FileType.File:
        make().write.mode("overwrite").parquet(f"{folder}/{sign}")
    return spark.read.parquet(f"{folder}/{sign}")
