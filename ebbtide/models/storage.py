"""Save and load fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stage_of(model: PipelineModel, kind: str) -> Transformer:
    """The stage whose class name is `kind`, such as 'GBTClassificationModel'."""
    found = [s for s in model.stages if type(s).__name__ == kind]
    if not found:
        names = ", ".join(type(s).__name__ for s in model.stages)
        raise KeyError(f"no stage {kind}; the model has {names}")
    return found[0]


def split_model(model: PipelineModel) -> tuple[PipelineModel, Transformer]:
    """Feature part and classifier of a fitted model."""
    return PipelineModel(stages=model.stages[:-1]), model.stages[-1]
