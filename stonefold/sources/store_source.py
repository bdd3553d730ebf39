"""A Python data source over a folder of packs: `spark.read.format("stonefold_packs").load(folder)`.

The pluggable backend of the engine: a partition for each pack file, which the
reading task opens itself, so the folder must be one that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stonefold_packs"

    def schema(self) -> str:
        return "path string, kind string, off long, len long, id string, ulen long"

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options["path"], self.options.get("deep", "false") == "true")


class PackReader(DataSourceReader):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder.removeprefix("file://"), deep

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.folder)) if n.endswith(".pack")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from stonefold.sources.packs import events

        with open(os.path.join(self.folder, partition.value), "rb") as f:
            for event in events(f.read(), self.deep):
                yield (partition.value, *event)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)
