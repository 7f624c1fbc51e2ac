"""Stored objects: listing without reading, and hashes that read only samples."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops import schemas as s
from mediaops.operators.uploads import parse_objects
from mediaops.session import materialise


def list_objects(spark: SparkSession, root: str, bucket: str, glob: str = "*") -> DataFrame:
    """Path below the root, full location, length, time, and what the path says. No content
    is read: only path, length and time are selected from the file source, which leaves out
    objects without content (``listing_table`` has them)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    # a root is written with or without scheme and host, and file:///a is found as file:/a
    folder = re.sub("/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)).rstrip("/")
    start = r"^[^/]*:(//[^/]*)?" if folder.startswith("/") or not folder else "^.*?"
    below = F.regexp_replace("location", start + r"\Q" + folder + r"\E/", "")
    listed = (
        files.withColumnRenamed("path", "location")
        .withColumnRenamed("modificationTime", "modified_at")
        .withColumn("path", below)
    )
    return parse_objects(listed, bucket)


def listing_table(spark: SparkSession, root: str, bucket: str, glob: str = "*") -> DataFrame:
    """What ``list_objects`` lists and the objects without content besides, found once and kept in the shared folder.

    Spark's file sources leave out files of no bytes, whatever the options, and gather all names on the driver. Here the
    folders of one depth are listed by a few tasks for each core, and those found in them are listed next. Names
    that begin with a dot or an underscore are left out, as by Spark.
    """
    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        top = f"file:{base}" if store.type_name == "local" else root.rstrip("/")
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                for entry in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    name, is_folder = entry.base_name, entry.type == fs.FileType.Directory
                    if not name.startswith((".", "_")) and (is_folder or fnmatchcase(name, glob)):
                        path = f"{folder}/{name}" if folder else name
                        rows.append((path, f"{top}/{path}", is_folder, entry.size or 0, (entry.mtime_ns or 0) // 1000))
            yield pd.DataFrame(rows, columns=["path", "location", "is_folder", "length", "modified_us"])

    kind, tasks = "path string, location string, is_folder boolean, length long, modified_us long", 8 * spark.sparkContext.defaultParallelism
    files, folders, waiting = [], spark.createDataFrame([("",)], "path string"), 1
    while waiting:
        found = materialise(folders.repartition(min(tasks, waiting)).mapInPandas(inside, kind), "listing")
        files.append(found.where("NOT is_folder"))
        folders = found.where("is_folder").select("path")
        waiting = folders.count()
    listed = reduce(DataFrame.unionByName, files).select(
        "location", F.timestamp_micros("modified_us").alias("modified_at"), "length", "path")
    return parse_objects(listed, bucket)


def content_fingerprint(
    objects: DataFrame, sample: int = s.SAMPLE_SIZE, parallelism: int | None = None
) -> DataFrame:
    """SHA-256 over samples of each object (``location``, ``length``) and its size.

    Samples are the head, the middle if the size exceeds two samples, the tail if it exceeds
    one, then the size as a little-endian double. Only these ranges are fetched, so the largest
    objects cost no more than small ones.
    """
    rows = objects.select("path", "location", "length")
    if parallelism:
        rows = rows.repartition(parallelism)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def one(location: str, size: int) -> str:
            if location.startswith("file:"):
                store, name = fs.LocalFileSystem(), location.removeprefix("file:")
            else:
                store, name = fs.FileSystem.from_uri(location)
            take = min(sample, size)
            starts = [0]
            if size > take * 2:
                starts.append((size - take) // 2)
            if size > take:
                starts.append(size - take)
            total = hashlib.sha256()
            with store.open_input_file(name) as data:
                for at in starts:
                    total.update(data.read_at(take, at))
            total.update(struct.pack("<d", size))
            return total.hexdigest()

        for batch in batches:
            batch["fingerprint"] = [
                one(loc, size) for loc, size in zip(batch["location"], batch["length"])
            ]
            yield batch[["path", "length", "fingerprint"]]

    return rows.mapInPandas(digest, "path string, length long, fingerprint string")
