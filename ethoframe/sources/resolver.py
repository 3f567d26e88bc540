"""Tables kept and made anew when what they come from has changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import staging


def fingerprint(spark: SparkSession, inputs: tuple[str, ...], settings: dict | None = None) -> str:
    """Of the names, sizes and times of all files under ``inputs`` and of ``settings``.
    A path that is not there is told from an empty folder."""
    seen: list = [json.dumps(settings or {}, sort_keys=True, default=str)]
    for path in inputs:
        at, system = staging.files(spark, path)
        if not system.exists(at):
            seen.append((path, None))
            continue
        found, base = system.listFiles(at, True), len(system.makeQualified(at).toString())
        own = []
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString()[base:]
            own.append((name, f.getLen(), f.getModificationTime()))
        seen.append((path, sorted(own)))
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()[:32]


def resolved(spark: SparkSession, folder: str, name: str, inputs: tuple[str, ...], make: Callable[[], DataFrame], settings: dict | None = None, keep: int = 1) -> DataFrame:
    """The table ``name`` in ``folder``: read if it was made from the same files with the
    same settings, made anew otherwise.

    It is written aside and renamed when whole, so a broken write is never read; if two
    make it at once, one rename wins and both read that. ``keep`` tables of a name stay,
    the newest; the others are removed, but for one that was made in between."""
    root = f"{folder}/{name}"
    target = f"{root}/v-{fingerprint(spark, inputs, settings)}"
    if not staging.exists(spark, f"{target}/_SUCCESS"):
        if staging.exists(spark, target):
            staging.remove(spark, target)  # not whole: no rename makes such a one
        aside = f"{root}/aside-{uuid.uuid4().hex}"
        try:
            make().write.parquet(aside)
            if not staging.replace(spark, aside, target) and not staging.exists(spark, f"{target}/_SUCCESS"):
                raise RuntimeError(f"{aside} could not be renamed to {target}")
        finally:
            staging.remove(spark, aside)
        _prune(spark, root, target, keep)
    return spark.read.parquet(target)


def _prune(spark: SparkSession, root: str, target: str, keep: int) -> None:
    at, system = staging.files(spark, root)
    own = [s for s in system.listStatus(at) if s.getPath().getName().startswith("v-")]
    own.sort(key=lambda s: (s.getPath().getName() == target.rsplit("/", 1)[1], s.getModificationTime()))
    for s in own[: max(0, len(own) - max(keep, 1))]:
        system.delete(s.getPath(), True)
