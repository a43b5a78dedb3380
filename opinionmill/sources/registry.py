"""A registry of fitted models: one folder, Parquet rows for what was saved and deleted."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, id string, kind string, path string, metrics string, info string, created double, deleted boolean"


class Registry:
    """Models under a root path that every executor reaches.

    Rows are appended, never rewritten: the latest row of a name is its state,
    and a deletion is a row of its own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, **row) -> None:
        order = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(row.get(c) for c in order)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/rows")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/rows")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _save(self, name: str, kind: str, write: Callable[[str], None], metrics: dict | None, info: dict | None) -> str:
        if not name:
            raise ValueError("a model needs a name")
        model_id = uuid.uuid4().hex
        path = f"{self.root}/models/{model_id}"
        write(path)
        self._append(name=name, id=model_id, kind=kind, path=path, metrics=json.dumps(metrics or {}), info=json.dumps(info or {}), created=time.time(), deleted=False)
        return path

    def save_pipeline(self, name: str, model: PipelineModel, metrics: dict | None = None, info: dict | None = None) -> str:
        return self._save(name, "pipeline", lambda path: model.write().save(path), metrics, info)

    def save_tables(self, name: str, tables: dict[str, DataFrame], metrics: dict | None = None, info: dict | None = None) -> str:
        def write(path: str) -> None:
            for part, df in tables.items():
                df.write.parquet(f"{path}/{part}")

        return self._save(name, "tables", write, metrics, (info or {}) | {"tables": sorted(tables)})

    def models(self) -> DataFrame:
        """name, kind, path, metrics, info, created of the models at hand."""
        rows = self._rows()
        latest = rows.groupBy("name").agg(F.max_by(F.struct("id", "kind", "path", "metrics", "info", "created", "deleted"), F.struct("created", "deleted", "id")).alias("r")).select("name", "r.*")
        gone = latest.where("deleted").select("name")
        return latest.join(gone, "name", "left_anti").drop("deleted").orderBy("name")

    def _row(self, name: str):
        found = self.models().where(F.col("name") == name).first()
        if found is None:
            raise FileNotFoundError(f"no model named {name!r} in {self.root}")
        return found

    def load(self, name: str) -> tuple[PipelineModel | dict[str, DataFrame], dict, dict]:
        """The model, its metrics and its info."""
        row = self._row(name)
        info = json.loads(row["info"])
        if row["kind"] == "pipeline":
            return PipelineModel.load(row["path"]), json.loads(row["metrics"]), info
        return {t: self.spark.read.parquet(f"{row['path']}/{t}") for t in info["tables"]}, json.loads(row["metrics"]), info

    def delete(self, name: str, remove_files: bool = True) -> None:
        row = self._row(name)
        self._append(name=name, id=row["id"], kind=row["kind"], path=row["path"], metrics="{}", info="{}", created=time.time(), deleted=True)
        if remove_files:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(row["path"])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
