"""read_cells(): files or tables to tidy rows, stage by stage, with stop and resume."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import as_cells
from ..operators.classify import Classifier, numeric_values
from ..operators.collate import Collated, collate_columns
from ..sources.explore import explore, read_findings
from .analyze import AnalyzeOptions, CellAnalysis, analyze_cells
from .compose import compose_blocks, compose_long, compose_wide

STAGES = ("detect_and_read", "make_cells", "va_classify", "analyze", "compose", "collate")


@dataclass(frozen=True)
class PipelineState:
    """What the pipeline holds after `stage`; later parts are None."""

    stage: str = "init"
    findings: DataFrame | None = None
    cells: DataFrame | None = None
    errors: DataFrame | None = None
    analysis: CellAnalysis | None = None
    composed: DataFrame | None = None
    collated: Collated | None = None
    options: AnalyzeOptions = field(default_factory=AnalyzeOptions)

    def result(self) -> object:
        return {"detect_and_read": self.findings, "make_cells": self.cells, "va_classify": self.cells, "analyze": self.analysis, "compose": self.composed, "collate": self.collated and self.collated.frame}.get(self.stage)


def _step(spark: SparkSession, state: PipelineState, stage: str, omit: tuple[str, ...], classifier: Classifier | None) -> PipelineState:
    if stage == "detect_and_read":
        return state
    if stage == "make_cells":
        if state.cells is None:
            cells, errors = read_findings(state.findings, omit)
            return replace(state, cells=cells, errors=errors)
        return state
    if stage == "va_classify":
        return replace(state, cells=(classifier or numeric_values)(state.cells))
    if stage == "analyze":
        return replace(state, analysis=analyze_cells(state.cells, state.options))
    if stage == "compose":
        long = compose_long(state.analysis)
        return replace(state, composed=compose_wide(long).withColumn("table_tag", F.col("sheet_id")))
    return replace(state, collated=collate_columns(list(compose_blocks(state.analysis).values())))


def read_cells(spark: SparkSession, source: str | DataFrame | PipelineState, at_level: str = "make_cells", from_level: str | None = None, omit: tuple[str, ...] = (), simplify: bool = True, classifier: Classifier | None = None, options: AnalyzeOptions | None = None, max_depth: float = math.inf) -> object:
    """Runs the stages up to `at_level` on a path, a table, or a state to go on from. A stage that fails is named in a warning
    and the result of the last one that worked is returned. simplify: the bare result instead of the state."""
    if at_level not in STAGES:
        raise ValueError(f"at_level must be one of {', '.join(STAGES)}")
    if isinstance(source, PipelineState):
        state = source
    elif isinstance(source, str):
        state = PipelineState(findings=explore(spark, source, max_depth))
    else:
        state = PipelineState(cells=as_cells(source))
    if options:
        state = replace(state, options=options)
    done = STAGES.index(from_level) - 1 if from_level else STAGES.index(state.stage) if state.stage in STAGES else -1
    for stage in STAGES[done + 1 : STAGES.index(at_level) + 1]:
        try:
            state = replace(_step(spark, state, stage, omit, classifier), stage=stage)
        except Exception as e:
            warnings.warn(f"Supplied at_level is {at_level}, but read_cells could reach {state.stage}: {e}", stacklevel=2)
            break
    return state.result() if simplify else state
