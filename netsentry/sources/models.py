"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from netsentry.sources import fs

MARKER = ".complete"


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def save(model, path: str) -> None:
    """Save, then write the marker that says the whole model is there."""
    path = path.rstrip("/")
    if fs.exists(_spark(), path + MARKER):
        fs.delete(_spark(), path + MARKER)
    model.write().overwrite().save(path)
    fs.touch(_spark(), path + MARKER)


def load_pipeline(path: str) -> PipelineModel:
    """A model saved by ``save``; a half-written one (no marker beside it) is an error."""
    if not fs.exists(_spark(), path.rstrip("/") + MARKER):
        raise FileNotFoundError(f"no complete model at {path}")
    return PipelineModel.load(path)


def load_if_saved(spark: SparkSession, path: str) -> PipelineModel | None:
    """The model at ``path``, or None if no whole one was saved there."""
    return PipelineModel.load(path) if fs.exists(spark, path.rstrip("/") + MARKER) else None


def load_or_fit(spark: SparkSession, path: str, pipeline, df: DataFrame) -> PipelineModel:
    """Load the model at ``path`` if one was saved there, else fit and save.

    The check goes through Hadoop's ``FileSystem``, so ``path`` may be on
    any shared store. The marker beside the model is written last: a
    half-written model has none and is refitted over.
    """
    model = load_if_saved(spark, path)
    if model is None:
        model = pipeline.fit(df)
        save(model, path)
    return model
