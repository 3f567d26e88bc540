"""Trained networks kept by setting: searches that resume, warm starts, and chains of
versions.

A network is a Parquet table with a row for each parameter (``training.state_table``),
written aside and renamed when whole, in a folder named by what it was made with: its
setting, what it started from, and the data. A search or chain that is run again reads
what is there and goes on with the rest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from ..sources import staging
from . import search, training
from .networks import Arrays, Network


def key_of(setting: dict) -> str:
    """The same for settings that differ in the order of their names only."""
    return hashlib.sha256(json.dumps(setting, sort_keys=True, default=str).encode()).hexdigest()[:24]


def save(spark: SparkSession, folder: str, key: str, network: Network, parameters: Arrays, note: dict) -> None:
    """Nothing happens if the key has a network already."""
    target = f"{folder}/{key}"
    if staging.exists(spark, f"{target}/_SUCCESS"):
        return
    aside = f"{folder}/_aside-{uuid.uuid4().hex}"
    try:
        training.state_table(spark, network, {"value": network.flat(parameters)}, note).coalesce(1).write.parquet(aside)
        if not staging.replace(spark, aside, target) and not staging.exists(spark, f"{target}/_SUCCESS"):
            raise RuntimeError(f"{aside} could not be renamed to {target}")
    finally:
        staging.remove(spark, aside)


def load(spark: SparkSession, folder: str, key: str, network: Network) -> tuple[Arrays, dict] | None:
    """(parameters, note), or none if the key has no whole network."""
    if not staging.exists(spark, f"{folder}/{key}/_SUCCESS"):
        return None
    (values,), note = training.read_state(spark.read.parquet(f"{folder}/{key}"), network, "value")
    return network.shaped(values), note


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kept network: key, its note as JSON (setting, score, parent), and how many
    numbers it has."""
    keys = [k for k in staging.folders(spark, folder) if not k.startswith("_") and staging.exists(spark, f"{folder}/{k}/_SUCCESS")]
    if not keys:
        return spark.createDataFrame([], "key string, note string, numbers long")
    from pyspark.sql import functions as F

    rows = spark.read.parquet(*[f"{folder}/{k}" for k in keys]).withColumn("key", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.groupBy("key").agg(F.first("note").alias("note"), F.sum(F.size("value")).cast("long").alias("numbers"))


def resumed_search(
    spark: SparkSession, folder: str, stages: list[tuple[str, tuple]], start: dict, build: Callable[[dict], tuple[Network, training.Settings]],
    rows: DataFrame, first: Callable[[dict], Arrays | None] = lambda setting: None, data: str = "", most: int | None = None,
) -> tuple[dict, list[tuple[dict, float]]]:
    """``search.staged`` where a setting's score is the best balanced accuracy of its
    network on validation rows (on training rows where there are none). Each network is
    kept by its setting and ``data`` (what tells the rows); settings that have one are not
    trained again. ``first`` gives what a setting starts from (a warm start), or none.
    ``most`` stops with RuntimeError after so many trainings; a later call goes on."""
    trained = 0

    def run(setting: dict) -> float:
        nonlocal trained
        network, how = build(setting)
        key = key_of({"setting": setting, "data": data, "how": asdict(how)})
        if (kept := load(spark, folder, key, network)) is not None:
            return kept[1]["score"]
        if most is not None and trained >= most:
            raise RuntimeError(f"stopped after {most} trainings")
        trained += 1
        found = training.fit(rows, network, how, first(setting))
        best = found.history[found.best_epoch - 1]
        score = best["val"] if best["val"] is not None else best["train"] or 0.0
        save(spark, folder, key, network, found.parameters, {"setting": setting, "score": score, "best_epoch": found.best_epoch, "data": data})
        return score

    return search.staged(stages, start, run)


def chain(spark: SparkSession, folder: str, versions: list[tuple[str, DataFrame]], network: Network, how: training.Settings, setting: dict | None = None) -> list[dict]:
    """One network after the other, each started from the one before. A version is
    trained twice: with its validation rows held out, for the best number of epochs, and
    then from the same start on all its rows for that many. Returns a row for each:
    version, key, parent, epochs, resumed."""
    parent, start, out = None, None, []
    for name, rows in versions:
        key = key_of({"version": name, "parent": parent, "setting": setting or {}, "how": asdict(how)})
        kept = load(spark, folder, key, network)
        if kept is None:
            epochs = max(1, training.fit(rows, network, how, start).best_epoch)
            whole = training.fit(rows.drop("is_val").selectExpr("*", "false as is_val"), network, replace(how, epochs=epochs), start)
            # as long as was found, not the best of it: there is nothing left to judge by
            save(spark, folder, key, network, whole.last, {"version": name, "parent": parent, "epochs": epochs, "setting": setting or {}})
        parameters, note = kept or load(spark, folder, key, network)
        out.append({"version": name, "key": key, "parent": parent, "epochs": note["epochs"], "resumed": kept is not None})
        parent, start = key, parameters
    return out


def lineage(spark: SparkSession, folder: str, key: str, network: Network) -> list[str]:
    """The versions that led to a network, the first one first."""
    out: list[str] = []
    while key is not None:
        kept = load(spark, folder, key, network)
        if kept is None:
            raise FileNotFoundError(f"{folder} has no network {key}")
        out.append(kept[1]["version"])
        key = kept[1]["parent"]
    return out[::-1]
