"""The plug-in point: engines that run named tasks, tried in order, with the built-in one last."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import functions as F

from pagelode.functions.vectors import quantize, quantize_params
from pagelode.operators.chunking import chunk_documents
from pagelode.operators.search import vector_topk


@dataclass(frozen=True)
class EngineResult:
    success: bool
    data: Any = None
    error: str | None = None
    duration: float = 0.0


class Engine(Protocol):
    id: str

    def supports(self, task: str) -> bool: ...

    def run(self, task: str, payload: dict[str, Any]) -> Any: ...


def _quantize(vectors, dimensions: int = 384, vector: str = "embedding"):
    params = quantize_params(F.col(vector), dimensions)
    return vectors.withColumn("params", params).withColumn("codes", quantize(F.col(vector), F.col("params"), dimensions))


@dataclass
class BuiltinEngine:
    """Chunking, quantizing and cosine top-k as DataFrame plans."""

    id: str = "builtin"
    tasks: dict[str, Callable[..., Any]] = field(default_factory=lambda: {
        "search:chunk": chunk_documents, "search:quantize": _quantize, "search:cosine": vector_topk,
    })

    def supports(self, task: str) -> bool:
        return task in self.tasks

    def run(self, task: str, payload: dict[str, Any]) -> Any:
        return self.tasks[task](**payload)


class Engines:
    """Engines in order of preference. A failed one passes the task on to the next."""

    def __init__(self, *engines: Engine) -> None:
        self.engines: list[Engine] = [*engines, BuiltinEngine()]

    def register(self, engine: Engine) -> None:
        self.engines.insert(0, engine)

    def active(self, task: str) -> str | None:
        """The id of the engine that a task goes to first."""
        return next((e.id for e in self.engines if e.supports(task)), None)

    def run_task(self, task: str, payload: dict[str, Any], throw: bool = False) -> EngineResult:
        """The first success; else the last error, raised if asked for. Plans are lazy, so errors at run time are the caller's."""
        began = time.perf_counter()
        error: Exception = LookupError(f"no engine runs {task}")
        for engine in self.engines:
            if not engine.supports(task):
                continue
            try:
                return EngineResult(True, engine.run(task, payload), None, time.perf_counter() - began)
            except Exception as e:  # noqa: BLE001 - any engine may fail in any way
                error = e
        if throw:
            raise error
        return EngineResult(False, None, str(error), time.perf_counter() - began)
