"""Trained pipelines kept beside the signature of the files they were trained on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tracemark.session import folder_exists, materialise, subfolders
from tracemark.sources.files import needs_training, source_signature

SIGNATURE = "file_path string, length long, modificationTime timestamp"


@dataclass(frozen=True)
class ModelStore:
    """Versions of one model under `folder`.

    A version is a folder with the pipeline, and the signature of its training files written last: without the signature's success marker it doesn't count, so a training
    cut short leaves the older version in use, and a reader never meets half a model. Versions are never changed; old ones can be removed by age.
    """

    spark: SparkSession
    folder: str

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        found = [int(name.removeprefix("version=")) for name in subfolders(self.spark, self.folder)]
        return sorted(v for v in found if folder_exists(self.spark, f"{self._path(v)}/signature/_SUCCESS"))

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version:06d}"

    def signature(self, version: int) -> DataFrame:
        return self.spark.read.schema(SIGNATURE).parquet(f"{self._path(version)}/signature")

    def load(self, version: int) -> PipelineModel:
        return PipelineModel.load(f"{self._path(version)}/model")

    def save(self, model: PipelineModel, signature: DataFrame) -> int:
        """Store a model as the next version."""
        taken = [int(name.removeprefix("version=")) for name in subfolders(self.spark, self.folder)]
        version = max(taken, default=0) + 1
        model.write().save(f"{self._path(version)}/model")
        signature.write.parquet(f"{self._path(version)}/signature")
        return version

    def current(self, source: str, fit: Callable[[], PipelineModel], force: bool = False) -> tuple[PipelineModel, int, bool]:
        """The model for the training files under `source`, its version and whether it had to be trained.

        The newest version is loaded if its files are those of now, by path, size and time of change; `fit` is called otherwise, or if asked for by `force`.
        The signature is taken before training: files that change meanwhile cause another training next time.
        """
        now = materialise(source_signature(self.spark, source), "signature")
        known = self.versions()
        if known and not force and not needs_training(now, self.signature(known[-1])):
            return self.load(known[-1]), known[-1], False
        model = fit()
        return model, self.save(model, now), True
