"""Publishing the outputs of a run as a whole.

A run writes all its outputs into a folder of its own, which nobody reads yet. One empty
marker file, made after the last output, makes them visible together: readers follow the
newest marker of a period. A run that dies before its marker leaves what was published
before, and a rerun never changes files that someone may be reading.

    <out>/runs/<period>/<run>/<output>/...
    <out>/published/<period>/<number>-<run>
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from rollcall.sinks.files import write_parquet
from rollcall.workdir import delete_path, list_names, make_empty_file, path_exists


def _markers(spark: SparkSession, out: str, period: str) -> list[str]:
    return sorted(list_names(spark, f"{out}/published/{period}"))


def publish(spark: SparkSession, out: str, period: str, run: Callable[[str], object]) -> str:
    """Call ``run`` with a new folder and make what it wrote there the outputs of ``period``.

    Returns the folder. Whatever ``run`` raises is passed on, with nothing published. An
    output whose write was not committed, or no output at all, is an error too.
    """
    name = uuid.uuid4().hex
    folder = f"{out}/runs/{period}/{name}"
    run(folder)
    outputs = list_names(spark, folder)
    if not outputs:
        raise ValueError(f"the run of {period} wrote nothing into {folder}")
    for output in outputs:
        if not _complete(spark, f"{folder}/{output}"):
            raise ValueError(f"output {output!r} of {period} is not complete")
    before = _markers(spark, out, period)
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    make_empty_file(spark, f"{out}/published/{period}/{number:010d}-{name}")
    return folder


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path``, or one to each of its folders (outputs by period), was committed."""
    if path_exists(spark, f"{path}/_SUCCESS"):
        return True
    inner = list_names(spark, path)
    return bool(inner) and all(path_exists(spark, f"{path}/{name}/_SUCCESS") for name in inner)


def publish_tables(spark: SparkSession, out: str, period: str, frames: Mapping[str, DataFrame]) -> str:
    """``publish`` of several named tables as Parquet."""
    return publish(spark, out, period, lambda folder: [write_parquet(df, f"{folder}/{name}") for name, df in frames.items()])


def published_folder(spark: SparkSession, out: str, period: str) -> str:
    """The folder that readers of ``period`` shall use now."""
    markers = _markers(spark, out, period)
    if not markers:
        raise FileNotFoundError(f"nothing is published for {period} in {out}")
    return f"{out}/runs/{period}/{markers[-1].split('-')[1]}"


def read_published(spark: SparkSession, out: str, period: str, output: str) -> DataFrame:
    """One Parquet output of the newest published run of ``period``."""
    return spark.read.parquet(f"{published_folder(spark, out, period)}/{output}")


def published_periods(spark: SparkSession, out: str) -> list[str]:
    return sorted(p for p in list_names(spark, f"{out}/published") if _markers(spark, out, p))


def sweep(spark: SparkSession, out: str, period: str, keep: int = 1) -> list[str]:
    """Delete all runs of ``period`` but the newest ``keep`` published ones; returns their names.

    Also deletes runs that died. Not for use while a run of the period is writing, or while
    readers still use an older one.
    """
    markers = _markers(spark, out, period)
    kept = {m.split("-")[1] for m in markers[len(markers) - keep :]} if keep else set()
    gone = [name for name in list_names(spark, f"{out}/runs/{period}") if name not in kept]
    for name in gone:
        for marker in markers:
            if marker.split("-")[1] == name:
                delete_path(spark, f"{out}/published/{period}/{marker}")
        delete_path(spark, f"{out}/runs/{period}/{name}")
    return gone
