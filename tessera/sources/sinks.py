"""Writers: line formats as one file per layout, and rows that hold whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_texts(lines: DataFrame, key: str = "file", ord: str = "ord", text: str = "text") -> DataFrame:
    """key and value: each key's lines in their order, as one text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(ord, text))), lambda s: s[text])
    return lines.groupBy(key).agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("value"))


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's content to folder/name on the file system that folder names; name, bytes and error of each.

    A file appears under its name only once it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            names, sizes, errors = batch.column(0).to_pylist(), [], []
            for file, data in zip(names, batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{file}"
                try:
                    system.create_dir(target.rpartition("/")[0])
                    with system.open_output_stream(f"{target}.part") as out:
                        out.write(data)
                    system.move(f"{target}.part", target)
                    sizes.append(len(data))
                    errors.append(None)
                except OSError as e:
                    sizes.append(0)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["name", "bytes", "error"])

    return rows.select(name, F.col(content).cast("binary")).mapInArrow(run, "name string, bytes long, error string")
