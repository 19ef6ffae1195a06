"""Queries on registries, manifests, verdicts and timings, on files through the MatrixMarket source, and their SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import compare as cmp
from lumenfold.functions import corpus as co
from lumenfold.operators import pattern as pt
from lumenfold.operators import solve as so
from lumenfold.operators.factored import Solver
from lumenfold.plans.options import DYNAMIC, LEVELLED
from lumenfold.plans.queries import SP, Q, _n, q, query
from lumenfold.plans.shared import scratch
from lumenfold.sources import generate as gen
from lumenfold.sources import matrixmarket as mm
from lumenfold.sources import tables as tb

#: Matrices described by tables: a group for each nation, a name and kind for each market segment; the manifest lists the first nations, some with other figures.
INDEX = """idx AS (SELECT n_name AS grp, c_mktsegment AS name, c_mktsegment AS kind, 1000 + 100 * count(*) AS n, 1000 + 100 * count(*) + CAST(min(n_nationkey) % 7 = 3 AS INTEGER) AS cols, 2500 + 400 * count(*) AS nnz,
  count(*) FILTER (WHERE c_acctbal > 0) / CAST(count(*) AS DOUBLE) AS psym, min(n_nationkey) % 5 <> 1 AS "real", false AS "binary", min(n_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
man AS (SELECT grp, name, kind, n + CAST(k = 2 AS INTEGER) AS n, nnz + CAST(k = 4 AS INTEGER) AS nnz, CASE WHEN k = 5 THEN psym / 2 ELSE psym END AS psym, CASE k % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' ELSE 'large' END AS tier FROM idx WHERE k < 9
  UNION ALL SELECT 'NOWHERE', 'lost', 'none', 1, 1, 1.0, 'quick')"""
BAND = "CASE WHEN psym >= 0.999 THEN 'sym' WHEN psym >= 0.5 THEN 'partial' ELSE 'unsym' END"


def _index(spark, sf) -> DataFrame:
    both = tb.read(spark, sf, "customer").join(tb.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    count = F.count(F.lit(1))
    by = both.groupBy(F.col("n_name").alias("grp"), F.col("c_mktsegment").alias("name")).agg(count.alias("c"), F.count_if(F.col("c_acctbal") > 0).alias("up"), F.min("n_nationkey").alias("k"))
    return by.selectExpr("grp", "name", "name AS kind", "1000 + 100 * c AS n", "1000 + 100 * c + int(k % 7 = 3) AS cols", "2500 + 400 * c AS nnz", "up / c AS psym", "k % 5 <> 1 AS real", "false AS binary", "k")


def _manifest(spark, sf) -> DataFrame:
    listed = _index(spark, sf).where("k < 9").selectExpr("grp", "name", "kind", "n + int(k = 2) AS n", "nnz + int(k = 4) AS nnz", "CASE WHEN k = 5 THEN psym / 2 ELSE psym END AS psym", "element_at(array('quick', 'standard', 'large'), int(k % 3) + 1) AS tier")
    return listed.union(spark.sql("SELECT 'NOWHERE', 'lost', 'none', 1L, 1L, 1.0D, 'quick'"))


@query(f"WITH {INDEX} SELECT {BAND} AS band, tier, count(*) AS n, CAST(sum(nnz) AS BIGINT) AS entries FROM man GROUP BY 1, 2")
def manifest_spread(spark, sf):
    return co.spread(_manifest(spark, sf))


@query(f"WITH {INDEX} SELECT grp, name, tier FROM man WHERE tier IN ('quick', 'standard')")
def manifest_tier(spark, sf):
    return co.at_most(_manifest(spark, sf), "standard", co.MANIFEST_TIERS).select("grp", "name", "tier")


@query(f"""WITH {INDEX} SELECT * FROM (SELECT m.grp, m.name, CASE WHEN i.grp IS NULL THEN 'unknown' WHEN m.n <> i.n THEN 'n' WHEN m.nnz <> i.nnz THEN 'nnz' WHEN abs(m.psym - i.psym) > 0.01 THEN 'psym' END AS problem
FROM man m LEFT JOIN idx i ON i.grp = m.grp AND i.name = m.name) WHERE problem IS NOT NULL""")
def manifest_verify(spark, sf):
    return co.verify(_manifest(spark, sf), _index(spark, sf))


@query(f"""WITH {INDEX} SELECT grp, name, CAST(n AS BIGINT) AS n, CAST(nnz AS BIGINT) AS nnz, {Q('psym')} AS psym, band, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY band, kind ORDER BY nnz, grp, name) AS r FROM (SELECT *, {BAND} AS band FROM idx WHERE "real" AND NOT "binary" AND n = cols AND n BETWEEN 1000 AND 60000 AND nnz >= 3 * n
  AND NOT EXISTS (SELECT 1 FROM man WHERE man.grp = idx.grp AND man.name = idx.name))) WHERE r = 1 ORDER BY nnz, grp, name LIMIT 8""")
def manifest_propose(spark, sf):
    """A top-8 report: the smallest new matrix of each band and kind."""
    return co.propose(_index(spark, sf), _manifest(spark, sf), 8).select("grp", "name", "n", "nnz", q("psym").alias("psym"), "band", "kind")


#: Generated systems by tier: label, generator and its sizes, note.
SYSTEMS = [
    ("lap2d_60x60", "laplacian2d/60/60", "small", "5-point grid"), ("lap2d_120x120", "laplacian2d/120/120", "large", "5-point grid"), ("lap3d_16", "laplacian3d/16/16/16", "small", "7-point grid"),
    ("lap3d_30", "laplacian3d/30/30/30", "huge", "7-point grid"), ("random_400", "random_unsymmetric_pattern/400", "small", "one direction a pair"), ("weakdiag_500", "weak_diagonal/500", "small", "tiny diagonal"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '/matrices/{b}')" for a, b, t, _ in SYSTEMS if t != "huge") + ") t(label, path)")
def registry_paths(spark, sf):
    return co.registry_paths(co.registry(spark, SYSTEMS), "large", "/matrices")


@query("""SELECT * FROM (VALUES ('grid', 'levelled', 'solved', true), ('grid', 'dynamic', 'solved', true), ('dead row', 'levelled', 'flagged', true), ('dead row', 'dynamic', 'flagged', true),
('too large', 'levelled', 'declined', true), ('too large', 'dynamic', 'declined', true), ('outside', 'levelled', 'error', false), ('outside', 'dynamic', 'error', false)) t(matrix, solver, outcome, honest)""")
def outcome_by_solver(spark, sf):
    return co.judged(_reports(spark))


@query("SELECT * FROM (VALUES ('grid', true, true), ('dead row', true, true), ('too large', true, true), ('outside', true, true)) t(matrix, feasible, fill)")
def solver_agreement(spark, sf):
    """Presets share the analysis: they agree on what can be factored, and on the fill."""
    return co.agreement(_reports(spark))


def _reports(spark) -> DataFrame:
    """Reports of both presets on four systems of 100 unknowns, with the residual measured by joins."""
    names = ["grid", "dead row", "too large", "outside"]
    base = gen.laplacian2d(spark, 10, 10).join(spark.range(4).withColumnRenamed("id", "system_id")).where("system_id <> 1 OR (row <> 40 AND col <> 40)")
    a = base.union(spark.sql("SELECT 500L, 3L, 1.0D, 3L"))
    b = gen.ramp(spark, 100).join(spark.range(4).withColumnRenamed("id", "system_id"))
    out = None
    for solver, o in (("levelled", LEVELLED), ("dynamic", DYNAMIC)):
        o = o.but(ordering="natural")
        parts = so.run(a.where("system_id <> 2"), b.where("system_id <> 2"), o, n=100, on_error="report").union(so.run(a.where("system_id = 2"), b.where("system_id = 2"), o.but(max_factor_nonzeros=500), n=100))
        x = so.solution(parts)
        ax = pt.multiply(a.where("row < 100"), x).select("system_id", "idx", F.col("val").alias("ax"))
        r = b.join(ax, ["system_id", "idx"], "left").join(x.select("system_id").distinct(), "system_id").groupBy("system_id").agg((F.sqrt(F.sum((F.col("val") - F.coalesce("ax", F.lit(0.0))) ** 2)) / F.sqrt(F.sum(F.col("val") ** 2))).alias("measured"))
        one = so.report(parts).join(r, "system_id", "left").select(F.element_at(F.array(*map(F.lit, names)), F.col("system_id").cast("int") + 1).alias("matrix"), F.lit(solver).alias("solver"), "status", "message", "factorized", "measured", "nnz_l")
        out = one if out is None else out.union(one)
    return out


@query("""WITH t AS (SELECT event_type AS phase, 1 + user_id % 4 AS threads, min(value) AS ms FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT CAST(threads AS BIGINT) AS threads, phase, floor(ms * 1e6 + 0.5) / 1e6 + 0.0 AS ms, floor(ms / sum(ms) OVER (PARTITION BY threads) * 1e6 + 0.5) / 1e6 + 0.0 AS share,
  floor(first_value(ms) OVER (PARTITION BY phase ORDER BY threads) / ms * 1e6 + 0.5) / 1e6 + 0.0 AS speedup FROM t""")
def phase_shares(spark, sf):
    """Events read as timings: kinds as phases, users' remainders as threads."""
    t = tb.read(spark, sf, "events").where("value > 0").select(F.col("event_type").alias("phase"), (1 + F.col("user_id") % 4).cast("long").alias("threads"), F.col("value").alias("ms"))
    return co.phase_shares(t).select("threads", "phase", q("ms").alias("ms"), q("share").alias("share"), q("speedup").alias("speedup"))


@query("""SELECT phase, min(value) FILTER (WHERE user_id % 2 = 0) AS "1", min(value) FILTER (WHERE user_id % 2 = 1) AS "2" FROM (SELECT event_type AS phase, * FROM events) GROUP BY phase""")
def thread_table(spark, sf):
    t = tb.read(spark, sf, "events").select(F.col("event_type").alias("phase"), (1 + F.col("user_id") % 2).cast("int").alias("threads"), F.col("value").alias("ms"))
    return cmp.thread_table(t)


@query("SELECT * FROM (VALUES (1, 'analyze', true), (1, 'factor', true), (1, 'solve', true), (2, 'analyze', true), (2, 'factor', true), (2, 'solve', true), (4, 'analyze', true), (4, 'factor', true), (4, 'solve', true)) t(jobs, phase, agrees)")
def job_sweep(spark, sf):
    """The phases timed with 1, 2 and 4 jobs; each solution is the known one."""
    a, x, rows = gen.laplacian2d(spark, 40, 40), gen.ramp(spark, 1600), []
    b = pt.multiply(a, x)
    for jobs in (1, 2, 4):
        s, times = Solver(spark, jobs=jobs), []
        began = time.time()
        for step in (lambda: s.analyze(a), lambda: s.factorize(a), lambda: s.solve(b)):  # noqa: B023
            got = step()
            times.append(time.time() - began)
            began = time.time()
        far = got.join(x.withColumnRenamed("val", "want"), ["idx", "rhs_id"]).agg(F.max(F.abs(F.col("val") - F.col("want")))).first()[0]
        rows += [(jobs, phase, 1000 * t, far < 1e-8) for phase, t in zip(("analyze", "factor", "solve"), times, strict=True)]
        s.drop()
    return spark.createDataFrame(rows, "jobs int, phase string, ms double, agrees boolean").select("jobs", "phase", (F.col("agrees") & (F.col("ms") > 0)).alias("agrees"))


# Files: tables written as MatrixMarket text and read again through the data source.
@query(f"WITH {SP} SELECT row, col, {Q('val')} AS val FROM a")
def matrixmarket_round_trip(spark, sf):
    a, n = tb.supplier_part(spark, sf), _n(spark, sf)
    return mm.read_matrix(spark, mm.write_matrix(a, n, n, scratch(spark, "sp.mtx"))).select("row", "col", q("val").alias("val"))


@query("""WITH e AS (SELECT DISTINCT n_nationkey AS i, r_regionkey + 30 AS j FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 0),
s AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e) SELECT kind, CAST(i AS BIGINT) AS row, CAST(j AS BIGINT) AS col, CASE WHEN kind = 'pattern' THEN 1.0 WHEN kind = 'skew-symmetric' AND i > j THEN i + j ELSE CASE WHEN kind = 'skew-symmetric' THEN -1.0 ELSE 1.0 END * (i + j) END AS val
FROM s CROSS JOIN (VALUES ('symmetric'), ('skew-symmetric'), ('pattern')) k(kind)""")
def matrixmarket_symmetry(spark, sf):
    """Lower triangles written with their symmetry; the reader mirrors them."""
    e = tb.read(spark, sf, "nation").where("n_nationkey > 0").select((F.col("n_regionkey") + 30).cast("long").alias("row"), F.col("n_nationkey").cast("long").alias("col"))
    a, out = e.withColumn("val", (F.col("row") + F.col("col")).cast("double")), None
    for kind, field, symmetry in (("symmetric", "real", "symmetric"), ("skew-symmetric", "real", "skew-symmetric"), ("pattern", "pattern", "symmetric")):
        path = mm.write_matrix(a, 40, 40, scratch(spark, f"{kind}.mtx"), field, symmetry)
        one = mm.read_matrix(spark, path).select(F.lit(kind).alias("kind"), "row", "col", "val")
        out = one if out is None else out.union(one)
    return out


@query("SELECT CAST(n_nationkey AS BIGINT) AS idx, 0 AS rhs_id, CAST(n_regionkey + 1 AS DOUBLE) AS val FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_nationkey AS DOUBLE) FROM nation WHERE n_nationkey <> 0")
def matrixmarket_dense(spark, sf):
    """A dense array, column by column; its zero is dropped."""
    two = tb.read(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("j"), (F.col("n_regionkey") + 1).cast("double").alias("v")), F.struct(F.lit(1).alias("j"), F.col("n_nationkey").cast("double").alias("v")))).alias("e"))
    lines = two.orderBy("e.j", "n_nationkey").select(F.col("e.v").cast("string").alias("value"))
    path = mm.write_text(lines, ["%%MatrixMarket matrix array real general", "25 2"], scratch(spark, "dense.mtx"))
    return mm.read_dense(spark, path)


@query("SELECT 'raised' AS truncated, 'raised' AS complex_as_real, 'raised' AS outside")
def matrixmarket_refusals(spark, sf):
    """Files that the reader refuses."""
    bad = {"truncated": ("coordinate real general", ["2 2 2", "1 1 1"]), "complex_as_real": ("coordinate complex general", ["1 1 1", "1 1 1 1"]), "outside": ("coordinate real general", ["2 2 1", "3 1 1"])}
    found = {}
    for name, (kind, rows) in bad.items():
        path = mm.write_text(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1), [f"%%MatrixMarket matrix {kind}"], scratch(spark, f"{name}.mtx"))
        try:
            mm.read_matrix(spark, path).collect()
            found[name] = "read"
        except Exception:  # noqa: BLE001  (Spark wraps what its workers raise)
            found[name] = "raised"
    return spark.createDataFrame([tuple(found[k] for k in bad)], list(bad))


@query(f"WITH {INDEX} SELECT grp, name, tier, CAST(n AS BIGINT) AS n, {Q('psym')} AS psym, grp = 'NATION_0' AS available FROM man WHERE grp <> 'NOWHERE'")
def manifest_file(spark, sf):
    """A manifest written as text with notes, read again, and which of its files are there: those of one nation."""
    m = _manifest(spark, sf).where("grp <> 'NOWHERE'")
    flat = lambda c: F.regexp_replace(c, " ", "~")
    rows = m.select(F.concat_ws(" ", flat("grp"), flat("name"), "tier", "n", "nnz", "psym", F.lit("false"), "kind").alias("value"))
    path = mm.write_text(rows, ["# group name tier n nnz psym spd kind", ""], scratch(spark, "manifest"))
    folder = scratch(spark, "cache")
    for name in sorted(r.name for r in m.where("grp = 'NATION_0'").select("name").distinct().collect()):  # market segments: a handful
        mm.write_text(spark.createDataFrame([("1 1 1",)], "value string"), ["%%MatrixMarket matrix coordinate pattern general", "1 1 1"], f"{folder}/NATION_0/{name.replace(' ', '~')}.mtx")
    back = lambda c: F.regexp_replace(c, "~", " ").alias(c)
    seen = co.with_availability(mm.read_manifest(spark, path), folder)
    return seen.select(back("grp"), back("name"), "tier", "n", q("psym").alias("psym"), "available")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS matrix, 's' AS solver, CASE WHEN n_nationkey % 2 = 0 THEN 2 * n_nationkey ELSE n_nationkey END AS nnz_l FROM nation")
def baseline_merge(spark, sf):
    """A baseline file, partly replaced: every second matrix has a new row."""
    rows = tb.read(spark, sf, "nation").selectExpr("string(n_nationkey) AS matrix", "'s' AS solver", "1L AS n", "1L AS nnz", "bigint(n_nationkey) AS nnz_l", "1L AS nnz_u", "1L AS supernodes", "1e-16D AS resid", "1.0D AS time_ms")
    path = scratch(spark, "baseline")
    mm.write_baseline(rows, path)
    new = rows.where("nnz_l % 2 = 0").withColumn("nnz_l", 2 * F.col("nnz_l"))
    again = scratch(spark, "merged")
    mm.write_baseline(mm.merge_baseline(mm.read_baseline(spark, path), new), again)
    return mm.read_baseline(spark, again).select("matrix", "solver", "nnz_l")
