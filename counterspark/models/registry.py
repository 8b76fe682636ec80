"""Models by name; ``register`` adds one."""

from __future__ import annotations

from .arima import ArimaModel
from .arnet import ArNetModel
from .base import BaseModel
from .hybrid import HybridModel
from .ols import TrendSeasonModel

MODELS: dict[str, type[BaseModel]] = {"prophet_xgb": HybridModel, "arima": ArimaModel, "neuralprophet": ArNetModel}
_INTERNAL: dict[str, type[BaseModel]] = {"trend_season": TrendSeasonModel}


def register(name: str, cls: type[BaseModel]) -> None:
    MODELS[name] = cls


def available_models() -> list[str]:
    return list(MODELS)


def model_class(name: str) -> type[BaseModel]:
    cls = MODELS.get(name) or _INTERNAL.get(name)
    if cls is None:
        raise ValueError(f"Unknown model {name!r}. Available models: {available_models()}.")
    return cls


def make_model(name: str, params: dict | None = None, state: dict | None = None) -> BaseModel:
    return model_class(name)(params, state)
