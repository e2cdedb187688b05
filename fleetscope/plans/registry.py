"""A registered query: the Spark plan and, where SQL can state it, its check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fleetscope.plans.inputs import Inputs


@dataclass(frozen=True)
class Entry:
    run: Callable[[Inputs], DataFrame]
    sql: str | None = None
