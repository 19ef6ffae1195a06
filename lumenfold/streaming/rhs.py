"""Factor once, solve a stream of right-hand sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenfold.operators.factored import Solver
from lumenfold.plans.options import SolveOptions


def solve_stream(a: DataFrame, rhs: DataFrame, sink: Callable[[DataFrame, int], None], options: SolveOptions = SolveOptions(), checkpoint: str | None = None, solver: Solver | None = None, **trigger) -> StreamingQuery:
    """Factor the matrix once (or take a ``solver`` that did), solve each micro-batch of ``rhs`` (idx, rhs_id, val) with its factors and hand the solution to ``sink``."""
    ready = solver or Solver(a.sparkSession, options).compute(a)
    out = rhs.writeStream.foreachBatch(lambda batch, number: sink(ready.solve(batch), number))
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
