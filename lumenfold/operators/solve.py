"""Analysis, factorization and solution of systems held in DataFrames: one grouped task a system."""

from __future__ import annotations

import contextlib
import ctypes
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.kernels import solver as sv
from lumenfold.operators import blocks as bl
from lumenfold.plans.options import SolveOptions
from lumenfold.plans.shared import checkpoint

OUT = "system_id long, part string, i long, j long, k long, re double, im double, text string"
ARROW = pa.schema([("system_id", pa.int64()), ("part", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("k", pa.int64()), ("re", pa.float64()), ("im", pa.float64()), ("text", pa.string())])
REPORT = (
    "status string, message string, factorized boolean, residual double, replaced_pivots long, refine_iterations int, nnz_l long, nnz_u long, predicted long, supernodes int, levels int, "
    "widest_level int, matching_perfect boolean, pattern_symmetry double, log_abs_det double, det_sign double, ordering string"
)


def keyed(df: DataFrame) -> DataFrame:
    return df if "system_id" in df.columns else df.withColumn("system_id", F.lit(0).cast("long"))


def complex_parts(df: DataFrame) -> DataFrame:
    """re, im instead of val (a number or a struct of both)."""
    if "val" not in df.columns:
        return df
    if df.schema["val"].dataType.simpleString().startswith("struct"):
        return df.withColumn("re", F.col("val.re")).withColumn("im", F.col("val.im")).drop("val")
    return df.withColumn("re", F.col("val").cast("double")).withColumn("im", F.lit(0.0)).drop("val")


def checked(df: DataFrame, names: list[str]) -> DataFrame:
    wrong = F.coalesce(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))) for c in names], F.lit(None))
    return df.withColumn(names[0], F.coalesce(wrong.cast(df.schema[names[0]].dataType), F.col(names[0])))


def let_go() -> None:
    """Give freed memory back: workers stay, and two of them and a JVM share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def values_of(pdf: pd.DataFrame, options: SolveOptions) -> np.ndarray:
    kind = np.dtype(options.dtype)
    return (pdf.re.to_numpy() + 1j * pdf.im.to_numpy() if kind.kind == "c" else pdf.re.to_numpy()).astype(kind)


def run(a: DataFrame, b: DataFrame | None, options: SolveOptions, want: tuple[str, ...] = ("x", "report"), n: int | None = None, trans: str = "N", values: DataFrame | None = None, on_error: str = "raise", tasks: int = 0) -> DataFrame:
    """Every wanted part of every system, in long form (``OUT``).

    ``a``: row, col, val (or re, im), optionally system_id; duplicates are summed. ``b``: idx, rhs_id, val. ``values``: a
    second matrix with the same pattern, factored with the first one's analysis. Without ``n`` a system's size is its largest index + 1. Nulls are
    refused. A system is one task (``Solver`` splits one over several, and keeps factors); the guard ``max_factor_nonzeros``, if set, refuses
    large factors before anything is allocated. ``on_error="report"`` gives a malformed system (an entry outside ``n``, say) the status ``error`` instead of
    failing all of them.
    Entries and right-hand sides that carry a ``block`` (see ``blocks``) are solved block by block, in ``tasks`` partitions if given; then only x can be wanted.
    Parts: x, report, perm, scale, supernode, block, source, etree, match, l_solve, u_solve, lower, upper, diag, phase.
    """
    block = ["block"] if "block" in a.columns else []
    if block and (b is None or values is not None or set(want) != {"x"}):
        raise ValueError("blocks are for solutions only")
    mats = checked(complex_parts(keyed(a)), ["row", "col", "re"]).select("system_id", F.lit(0).cast("byte").alias("what"), F.col("row").alias("i"), F.col("col").alias("j"), "re", "im", *block)
    if values is not None:
        mats = mats.union(checked(complex_parts(keyed(values)), ["row", "col", "re"]).select("system_id", F.lit(1).cast("byte"), "row", "col", "re", "im"))
    if b is not None:
        mats = mats.union(checked(complex_parts(keyed(b)), ["idx", "re"]).select("system_id", F.lit(2).cast("byte"), F.col("idx"), F.col("rhs_id").cast("long"), "re", "im", *block))
    solves = b is not None

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = taken(batches)
        system = held[0]
        try:
            out = one(held)
        except (ValueError, IndexError, ArithmeticError, np.linalg.LinAlgError) as error:
            if on_error != "report":
                raise
            text = json.dumps({"status": "error", "message": str(error) or type(error).__name__, "factorized": False})
            out = pd.DataFrame({"system_id": [system], "part": "report", "i": 0, "j": 0, "k": 0, "re": math.nan, "im": 0.0, "text": text})
        let_go()
        yield pa.RecordBatch.from_pandas(out, ARROW, preserve_index=False)

    def taken(batches: Iterator[pa.RecordBatch]) -> list:
        """The system, its block, and for each code its i, j and values: batches are cut down as they come, so that a system is held once."""
        kind = np.dtype(options.dtype)
        parts: list[list[tuple]] = [[], [], []]
        system = block_id = 0
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            system, block_id = col["system_id"][0].as_py(), col["block"][0].as_py() if block else -1
            what = col["what"].to_numpy()
            for code in np.unique(what):
                of = np.flatnonzero(what == code)
                i, j, re = (col[c].to_numpy(zero_copy_only=False)[of] for c in ("i", "j", "re"))
                parts[code].append((i, j, (re + 1j * col["im"].to_numpy(zero_copy_only=False)[of] if kind.kind == "c" else re).astype(kind)))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        out = [system, block_id]
        for k, p in enumerate(parts):
            out.append(tuple(np.concatenate(x) for x in zip(*p, strict=True)) if p else empty)
            parts[k] = []
        let_go()
        return out

    def one(held: list) -> pd.DataFrame:
        """Takes what ``held`` has, so that nothing is held twice."""
        kind = np.dtype(options.dtype)
        system, block_id, (row, col, val), second, (bi, bj, bv) = held
        held.clear()
        index = None
        if block and block_id >= 0:
            index = sv.sy.distinct(row)
            row, col, bi = (np.searchsorted(index, x) for x in (row, col, bi))
        size = len(index) if index is not None else n if n is not None else int(max([-1, *(int(x.max()) for x in (row, col, bi) if len(x))])) + 1
        out: list[pd.DataFrame] = []

        def put(part, i, j=0, k=0, re=math.nan, im=0.0, text=None):
            if part in want:
                out.append(pd.DataFrame({"system_id": system, "part": part, "i": i, "j": j, "k": k, "re": re, "im": im, "text": text}, index=range(len(i)) if np.ndim(i) else [0]))

        def table(part, m):
            i, j = np.indices(m.shape)
            i = i if index is None else index[i]
            put(part, i.ravel(), j.ravel(), 0, np.real(m).ravel().astype(float), np.imag(m).ravel().astype(float))

        an = sv.analyze(size, row, col, val, options)
        s = an.structure
        put("perm", np.arange(size), an.row_to, an.col_to)
        put("match", np.arange(size), an.match)
        put("etree", np.arange(size), s.parent, s.counts)
        put("supernode", np.arange(len(s.first)), s.first, s.last, s.below.astype(float), s.level.astype(float))
        for part, rows in (("block", s.blocks), ("source", s.sources)):
            if part in want and (found := rows()):
                r = np.array(found)
                put(part, r[:, 0], r[:, 1], r[:, 2], *r[:, 3:5].T.astype(float))
        f = sv.factorize(an, *(second if len(second[0]) else (row, col, val)))
        put("scale", np.arange(size), 0, 0, f.dr, f.dc)
        factored = f.ok
        report = {"factorized": factored, "ordering": an.ordering, "matching_perfect": bool(an.perfect), "nnz_l": s.factor_nonzeros(), "nnz_u": s.factor_nonzeros(), "predicted": s.predicted(), "supernodes": len(s.first)}
        levels = np.bincount(s.level) if len(s.level) else np.zeros(0, int)
        report |= {"levels": len(levels), "widest_level": int(levels.max()) if len(levels) else 0, "replaced_pivots": f.replaced, "pattern_symmetry": _symmetry(row, col, size)}
        if factored:
            report |= {"log_abs_det": f.log_abs_det(), "det_sign": f.det_sign() if kind.kind != "c" else None}
            if kind.kind == "c":
                d = f.det_sign()
                put("phase", 0, 0, 0, d.real, d.imag)
            for which in ("lower", "upper"):
                if which in want:
                    i, j, v = f.triangle(which)
                    put(which, i, j, 0, np.real(v).astype(float), np.imag(v).astype(float))
            if solves:
                k = int(bj.max()) + 1 if len(bj) else 1
                dense = np.zeros((size, k), kind)
                np.add.at(dense, (bi, bj), bv)
                x = f.solve(dense, trans)
                table("x", x)
                if "l_solve" in want:
                    table("l_solve", f.lower(dense))
                if "u_solve" in want:
                    table("u_solve", f.upper(dense))
            d = f.diagonal()
            put("diag", np.arange(size), 0, 0, np.real(d).astype(float), np.imag(d).astype(float))
        report |= {"status": "success" if f.ok else "numerical_issue", "message": f.message, "residual": f.residual, "refine_iterations": f.iterations}
        report = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in report.items()}
        put("report", 0, text=json.dumps(report))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("system_id", "part", "i", "j", "k", "re", "im", "text")})

    if block and tasks:
        mats = mats.repartition(tasks, "system_id", "block")
    return mats.groupBy("system_id", *block).applyInArrow(guarded, OUT)


def _symmetry(row: np.ndarray, col: np.ndarray, n: int) -> float:
    off = row != col
    code = np.unique(row[off] * n + col[off])
    return float(np.isin(code % max(n, 1) * n + code // max(n, 1), code).mean()) if len(code) else 1.0


def solution(parts: DataFrame, part: str = "x") -> DataFrame:
    return parts.where(F.col("part") == part).select("system_id", F.col("i").alias("idx"), F.col("j").cast("int").alias("rhs_id"), F.col("re").alias("val"), "im")


def report(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'report'").select("system_id", F.from_json("text", REPORT).alias("r")).select("system_id", "r.*")


def solve(a: DataFrame, b: DataFrame, options: SolveOptions = SolveOptions(), split: bool = False, **more) -> DataFrame:
    """``system_id, idx, rhs_id, val, im`` of A x = b; read ``report(run(...))`` for the status.

    With ``split`` the connected blocks of a system are scaled, factored and refined apart, each by a task; one that cannot be factored gives no rows.
    """
    if split:
        a, table = bl.split(checked(complex_parts(keyed(a)), ["row", "col", "re"]).select("system_id", "row", "col", "re", "im"), more.get("n"))
        b = bl.sides(checkpoint(checked(complex_parts(keyed(b)), ["idx", "re"]).select("system_id", "idx", "rhs_id", "re", "im")), table)
        more["tasks"] = bl.tasks(table)
    return solution(run(a, b, options, ("x",), **more))


def parity_of(perm: DataFrame) -> DataFrame:
    """Sign of one permutation ``orig, internal``: even cycles turn it. Cycles are found by doubling: every element learns the least of 2, 4, 8, ... successors."""
    at = checkpoint(perm.select(F.col("orig").alias("v"), F.col("internal").alias("to"), F.least("orig", "internal").alias("low")))
    n, reach = at.count(), 1
    while reach < n:
        after = at.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("low").alias("far"))
        at = checkpoint(at.join(after, "to").select("v", F.col("next").alias("to"), F.least("low", "far").alias("low")))
        reach *= 2
    cycles = at.groupBy("low").count()
    return cycles.agg(F.when(F.count_if(F.col("count") % 2 == 0) % 2 == 0, 1).otherwise(-1).cast("int").alias("sign"))
