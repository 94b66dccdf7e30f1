"""One file per row, written, listed and read by the tasks: names and texts never pass through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files lie in this many folders, cut by the hash of their names, so that a folder of a large table is listed in pieces.
SLICE = "slice="
SLICES = 4096

# What one batch of read files holds at most, besides its last file.
BATCH_FILES, BATCH_BYTES = 1024, 16 << 20


def write_files(df: DataFrame, folder: str, name: str, text: str, sliced: bool = False) -> str:
    """Write the text of every row to the file that its ``name`` column gives, and return ``folder``.

    ``sliced`` spreads the files over slices of the folder, which ``read_files`` puts together. Each name has to be unique. A task that runs again writes the same bytes to the same names. Missing texts are empty
    files, rows without a name are left out. ``folder`` must be shared by the cluster: an absolute path or a URI.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for file, body, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if piece not in made:
                    target.create_dir(f"{base}{piece}", recursive=True)
                    made.add(piece)
                with target.open_output_stream(f"{base}{piece}/{file}") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    file = F.col(name).cast("string")
    piece = F.concat(F.lit(f"/{SLICE}"), F.pmod(F.xxhash64(file), F.lit(SLICES)).cast("string")) if sliced else F.lit("")
    rows = df.filter(F.col(name).isNotNull()).select(file, F.col(text).cast("string"), piece)
    rows.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
    # A table without rows still leaves a folder.
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    return folder


def read_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(name, text) of the files with an ending in a folder and in its slices; empty and hidden files are left out.

    One task lists the folder itself, others its slices, and the files are read by many tasks, each many of them.
    ``folder`` is an absolute path or a URI, as for ``write_files``.
    """

    def listed(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, base = fs.FileSystem.from_uri(path)
                found = []
                for item in source.get_file_info(fs.FileSelector(base)):
                    if item.type == fs.FileType.Directory:
                        if not inside and item.base_name.startswith(SLICE):
                            found.append((f"{path}/{item.base_name}", True))
                    elif item.size != 0 and item.base_name.endswith(suffix) and item.base_name[:1] not in "._":
                        found.append((f"{path}/{item.base_name}", False))
                for at in range(0, len(found), 10_000):
                    paths, folders = zip(*found[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(folders)], names=["path", "is_folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, pa.binary())], names=["name", "bytes"])

        names, texts, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, file = fs.FileSystem.from_uri(path)
                with source.open_input_stream(file) as body:
                    texts.append(body.read())
                names.append(path.rsplit("/", 1)[1])
                held += len(texts[-1])
                if len(names) == BATCH_FILES or held >= BATCH_BYTES:
                    yield packed()
                    names, texts, held = [], [], 0
        if names:
            yield packed()

    kind = "path string, is_folder boolean"
    tasks = 4 * spark.sparkContext.defaultParallelism
    top = spark.range(1, numPartitions=1).select(F.lit(folder.rstrip("/")).alias("path"))
    top = top.mapInArrow(lambda batches: listed(batches, False), kind)
    slices = top.filter("is_folder").select("path").repartition(tasks, "path")
    files = top.filter("NOT is_folder").unionByName(slices.mapInArrow(lambda batches: listed(batches, True), kind))
    texts = files.select("path").repartition(tasks, "path").mapInArrow(read, "name string, bytes binary")
    return texts.select("name", F.col("bytes").cast("string").alias("text"))
