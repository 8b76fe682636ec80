"""Interrupted time-series counterfactual analysis on Spark.

``run_single_its`` analyses one series, ``run_batch`` many in one plan;
``compare_models``, ``time_series_cv`` and ``tune_model`` choose among forecasters.
Names load on first use, so a Python worker imports only what its task needs.
"""

from importlib import import_module

_WHERE = {
    "load_config": ".config", "assign_splits": ".operators.splits", "BatchResult": ".plans.batch", "run_batch": ".plans.batch",
    "PipelineResult": ".plans.single", "run_single_its": ".plans.single", "CVResult": ".plans.tuning", "TuningResult": ".plans.tuning",
    "compare_models": ".plans.tuning", "time_series_cv": ".plans.tuning", "tune_model": ".plans.tuning",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name], __name__), name)
