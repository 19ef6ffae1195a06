"""A query for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import compare as cmp
from lumenfold.functions.structs import rows as rows_of
from lumenfold.operators import pattern as pt
from lumenfold.operators import solve as so
from lumenfold.plans.options import DYNAMIC, LEVELLED
from lumenfold.plans.shared import checkpoint
from lumenfold.sources import generate as gen
from lumenfold.sources import tables as tb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(c: Column | str) -> Column:
    """Six decimals, the same in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6 + 0.0


def Q(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 + 0.0"


#: The supplier-part matrix in SQL: parts first, then suppliers.
SP = """
pc AS (SELECT count(*) AS p FROM part), sc AS (SELECT count(*) AS s FROM supplier),
pair AS (SELECT l_partkey AS pk, l_suppkey AS sk, sum(l_quantity) AS qt, sum(1 + l_discount) AS dc FROM lineitem GROUP BY 1, 2),
offd AS (SELECT sk + p AS row, pk AS col, qt AS val FROM pair, pc UNION ALL SELECT pk, sk + p, dc FROM pair, pc),
a AS (SELECT * FROM offd UNION ALL
      SELECT i.i, i.i, 1 + coalesce(t.s, 0) FROM (SELECT unnest(range(0, p + s)) AS i FROM pc, sc) i LEFT JOIN (SELECT row, sum(abs(val)) AS s FROM offd GROUP BY row) t ON t.row = i.i)
"""
N_SP = "(SELECT p + s FROM pc, sc)"
RAMP = f"SELECT i AS idx, 1 + 0.25 * (i % 5) AS val FROM (SELECT unnest(range(0, {N_SP})) AS i)"


def _n(spark: SparkSession, sf: str) -> int:
    return tb.read(spark, sf, "part").count() + tb.read(spark, sf, "supplier").count()


# Pattern.
@query("SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2")
def coo_assemble(spark, sf):
    li = tb.read(spark, sf, "lineitem")
    return pt.assemble(li.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val")))


@query(f"WITH {SP} SELECT CAST(count(*) AS BIGINT) AS nnz, CAST(max(k) OVER () AS BIGINT) AS most_in_row, {N_SP} AS n, {Q(f'count(*) / CAST({N_SP} AS DOUBLE) / {N_SP} * 1000')} AS density_1000 FROM a, (SELECT max(c) AS k FROM (SELECT count(*) AS c FROM a GROUP BY row)) GROUP BY k")
def nnz_stats(spark, sf):
    return pt.stats(tb.supplier_part(spark, sf), _n(spark, sf)).select("nnz", "most_in_row", "n", q(F.col("density") * 1000).alias("density_1000"))


UPWIND = "u AS (SELECT i * 20 + j AS row, i * 20 + j + d.o AS col, d.v AS val FROM (SELECT unnest(range(0, 20)) AS i) CROSS JOIN (SELECT unnest(range(0, 20)) AS j) CROSS JOIN (VALUES (0, 4.0), (-1, -1.0), (-20, -1.0)) d(o, v) WHERE (o = 0 OR (o = -1 AND j > 0) OR (o = -20 AND i > 0)))"


@query(f"WITH {UPWIND} SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (SELECT row AS src, col AS dst FROM u UNION ALL SELECT col, row FROM u) WHERE src <> dst")
def symmetrize_pattern(spark, sf):
    return pt.edges(gen.upwind2d(spark, 20, 20))


@query(f"WITH {UPWIND} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(sum(val) AS DOUBLE) AS val FROM (SELECT * FROM u UNION ALL SELECT col, row, 0 FROM u) GROUP BY 1, 2")
def pad_pattern(spark, sf):
    return pt.pad(gen.upwind2d(spark, 20, 20))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS r, l_suppkey AS c FROM lineitem WHERE l_partkey <> l_suppkey),
m AS (SELECT count(*) AS n, count(f.r) AS b FROM e LEFT JOIN e f ON f.r = e.c AND f.c = e.r)
SELECT floor(b / CAST(n AS DOUBLE) * 1e6 + 0.5) / 1e6 AS symmetry, n = b AS symmetric FROM m""")
def pattern_symmetry(spark, sf):
    li = tb.read(spark, sf, "lineitem")
    a = li.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(1.0).alias("val"))
    return pt.pattern_symmetry(a).select(q("symmetry").alias("symmetry"), "symmetric")


@query(f"WITH {UPWIND} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM u WHERE row <> col")
def mirror_missing(spark, sf):
    return pt.mirror_missing(gen.upwind2d(spark, 20, 20))


@query("SELECT CAST((i * 7) % 100 AS BIGINT) AS row, CAST((j * 7) % 100 AS BIGINT) AS col, v AS val FROM (SELECT y * 10 + x AS i, y * 10 + x + d AS j, CAST(v AS DOUBLE) AS v FROM (SELECT unnest(range(0, 10)) AS x) CROSS JOIN (SELECT unnest(range(0, 10)) AS y) CROSS JOIN (VALUES (0, 4), (1, -1), (-1, -1), (10, -1), (-10, -1)) t(d, v) WHERE d = 0 OR (d = 1 AND x < 9) OR (d = -1 AND x > 0) OR (d = 10 AND y < 9) OR (d = -10 AND y > 0))")
def relabel_pattern(spark, sf):
    perm = spark.range(100).select(F.col("id").alias("orig"), ((F.col("id") * 7) % 100).alias("internal"))
    return pt.relabel(gen.laplacian2d(spark, 10, 10), perm)


@query(f"WITH {UPWIND} SELECT CAST((row + 1) % 400 AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(val AS DOUBLE) AS val FROM u")
def apply_row_matching(spark, sf):
    match = spark.range(400).select(F.col("id").alias("row"), ((F.col("id") + 1) % 400).alias("col"))
    return pt.permute_rows(gen.upwind2d(spark, 20, 20), match)


# Generators.
@query("SELECT CAST(y * 60 + x AS BIGINT) AS row, CAST(y * 60 + x + d AS BIGINT) AS col, CAST(v AS DOUBLE) AS val FROM (SELECT unnest(range(0, 60)) AS x) CROSS JOIN (SELECT unnest(range(0, 60)) AS y) CROSS JOIN (VALUES (0, 4), (1, -1), (-1, -1), (60, -1), (-60, -1)) t(d, v) WHERE d = 0 OR (d = 1 AND x < 59) OR (d = -1 AND x > 0) OR (d = 60 AND y < 59) OR (d = -60 AND y > 0)")
def grid2d(spark, sf):
    return gen.laplacian2d(spark, 60, 60)


@query("SELECT CAST(z * 256 + y * 16 + x AS BIGINT) AS row, CAST(z * 256 + y * 16 + x + d AS BIGINT) AS col, CAST(v AS DOUBLE) AS val FROM (SELECT unnest(range(0, 16)) AS x) CROSS JOIN (SELECT unnest(range(0, 16)) AS y) CROSS JOIN (SELECT unnest(range(0, 16)) AS z) CROSS JOIN (VALUES (0, 6), (1, -1), (-1, -1), (16, -1), (-16, -1), (256, -1), (-256, -1)) t(d, v) WHERE d = 0 OR (d = 1 AND x < 15) OR (d = -1 AND x > 0) OR (d = 16 AND y < 15) OR (d = -16 AND y > 0) OR (d = 256 AND z < 15) OR (d = -256 AND z > 0)")
def grid3d(spark, sf):
    return gen.laplacian3d(spark, 16, 16, 16)


@query(f"WITH {UPWIND} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(val AS DOUBLE) AS val FROM u")
def upwind2d(spark, sf):
    return gen.upwind2d(spark, 20, 20)


def U(seed: int, *args: str) -> str:
    """SQL of ``gen.uniform``."""
    return f"(CAST('0x' || substr(md5(concat_ws(',', {seed}, {', '.join(args)})), 1, 12) AS BIGINT) / 281474976710656.0)"


def _random_sql(name: str, n: int, p: float, seed: int, both: bool) -> str:
    """The random families in SQL, ``name(row, col, val)``."""
    pairs = f"""{name}_s AS (SELECT i, unnest(range(1, CAST(ceil((n - i) * {p} + 12 * sqrt((n - i) * {p}) + 20) AS BIGINT) + 1)) AS k FROM (SELECT unnest(range(0, {n})) AS i, {n} AS n)),
{name}_p AS (SELECT i, j FROM (SELECT i, i + CAST(sum(1 + floor(ln(1 - {U(seed, 'i', 'k')}) / ln(1 - {p}))) OVER (PARTITION BY i ORDER BY k) AS BIGINT) AS j FROM {name}_s) WHERE j < {n})"""
    value = lambda a, b: f"2 * {U(seed + 1, a, b)} - 1"
    if both:
        off = f"SELECT i AS row, j AS col, {value('i', 'j')} AS val FROM {name}_p UNION ALL SELECT j, i, {value('j', 'i')} FROM {name}_p"
    else:
        off = f"SELECT CASE WHEN up THEN i ELSE j END AS row, CASE WHEN up THEN j ELSE i END AS col, {value('i', 'j')} AS val FROM (SELECT i, j, {U(seed + 2, 'i', 'j')} < 0.5 AS up FROM {name}_p)"
    return f"{pairs}, {name} AS ({off} UNION ALL SELECT i, i, {n} + {U(seed + 9, 'i')} FROM (SELECT unnest(range(0, {n})) AS i))"


WEAK = f"""weak AS (SELECT row, col, sum(val) AS val FROM (
  SELECT i AS row, i AS col, 1e-3 * (2 * {U(7, 'i')} - 1) AS val FROM r UNION ALL SELECT i, i + 1, 2 + (2 * {U(8, 'i')} - 1) FROM r WHERE i + 1 < 120
  UNION ALL SELECT i + 1, i, 2 + (2 * {U(9, 'i')} - 1) FROM r WHERE i + 1 < 120 UNION ALL SELECT i, (i + 5) % 120, 1.5 + (2 * {U(10, 'i')} - 1) FROM r WHERE i % 3 = 0) GROUP BY row, col)"""
ABOUT = """SELECT '{0}' AS family, CAST((SELECT count(*) FROM {1}) AS BIGINT) AS nnz, {2} AS symmetry, {3} AS largest
FROM (SELECT DISTINCT row, col FROM {1} WHERE row <> col) e LEFT JOIN (SELECT DISTINCT row, col FROM {1}) m ON m.row = e.col AND m.col = e.row"""


def _about(family: str, table: str) -> str:
    return ABOUT.format(family, table, Q("count(m.row) / CAST(count(*) AS DOUBLE)"), f"(SELECT {Q('max(abs(val))')} FROM {table} WHERE row <> col)")


@query(f"WITH r AS (SELECT unnest(range(0, 120)) AS i), {_random_sql('sym', 120, 0.05, 7, True)}, {_random_sql('uns', 120, 0.05, 7, False)}, {WEAK} {_about('symmetric', 'sym')} UNION ALL {_about('unsymmetric', 'uns')} UNION ALL {_about('weak', 'weak')}")
def random_systems(spark, sf):
    """The three seeded families, each with its size, symmetry and largest off-diagonal magnitude."""
    out = None
    for name, a in (("symmetric", gen.random_symmetric_pattern(spark, 120, 0.05, 7)), ("unsymmetric", gen.random_unsymmetric_pattern(spark, 120, 0.05, 7)), ("weak", gen.weak_diagonal(spark, 120, 7))):
        a = a.toDF("row", "col", "val")
        one = pt.pattern_symmetry(a).join(a.agg(F.count(F.lit(1)).alias("nnz"), F.max(F.when(F.col("row") != F.col("col"), F.abs("val"))).alias("largest")))
        one = one.select(F.lit(name).alias("family"), "nnz", q("symmetry").alias("symmetry"), q("largest").alias("largest"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {SP}, x AS (SELECT i AS idx, 2 * {U(21, 'i')} - 1 AS val FROM (SELECT unnest(range(0, {N_SP})) AS i)) SELECT row AS idx, 0 AS rhs_id, {Q('sum(a.val * x.val)')} AS val FROM a JOIN x ON x.idx = a.col GROUP BY row")
def seeded_rhs(spark, sf):
    """b = A x for a seeded x."""
    return _x(pt.multiply(tb.supplier_part(spark, sf), gen.seeded(spark, _n(spark, sf), 21)))


@query("SELECT i AS idx, 0 AS rhs_id, floor((1 + 0.5 * sin(i)) * 1e6 + 0.5) / 1e6 AS val FROM (SELECT unnest(range(0, 500)) AS i)")
def sine_rhs(spark, sf):
    return gen.sine(spark, 500).select("idx", "rhs_id", q("val").alias("val"))


# Scaling.
@query(f"WITH {SP} SELECT 'row' AS axis, row AS idx, {Q('max(abs(val))')} AS norm FROM a GROUP BY row UNION ALL SELECT 'col', col, {Q('max(abs(val))')} FROM a GROUP BY col")
def row_col_inf_norms(spark, sf):
    return pt.norms(tb.supplier_part(spark, sf)).select("axis", "idx", q("norm").alias("norm"))


def _sweeps(count: int) -> str:
    """Chained sweeps; a sweep leaves everything as it is once all norms are within 0.1 of 1."""
    out = [SP, "s0 AS (SELECT row AS i, 1.0::DOUBLE AS r, 1.0::DOUBLE AS c FROM (SELECT DISTINCT row FROM a))"]
    for k in range(count):
        out.append(f"m{k} AS (SELECT a.row, a.col, abs(val) * x.r * y.c AS v FROM a JOIN s{k} x ON x.i = a.row JOIN s{k} y ON y.i = a.col)")
        out.append(f"r{k} AS (SELECT row AS i, max(v) AS n FROM m{k} GROUP BY row), c{k} AS (SELECT col AS i, max(v) AS n FROM m{k} GROUP BY col)")
        out.append(f"f{k} AS (SELECT max(abs(1 - n)) >= 0.1 AS far FROM (SELECT n FROM r{k} UNION ALL SELECT n FROM c{k}))")
        out.append(f"s{k + 1} AS (SELECT s.i, CASE WHEN far THEN s.r / sqrt(r.n) ELSE s.r END AS r, CASE WHEN far THEN s.c / sqrt(c.n) ELSE s.c END AS c FROM s{k} s JOIN r{k} r ON r.i = s.i JOIN c{k} c ON c.i = s.i, f{k})")
    return ", ".join(out)


@query(f"WITH {_sweeps(5)} SELECT 'row' AS axis, i AS idx, {Q('r')} AS scale FROM s5 UNION ALL SELECT 'col', i, {Q('c')} FROM s5")
def ruiz_scales(spark, sf):
    return pt.ruiz(tb.supplier_part(spark, sf)).select("axis", "idx", q("scale").alias("scale"))


@query(f"WITH {_sweeps(5)} SELECT row, col, {Q('val * x.r * y.c')} AS val FROM a JOIN s5 x ON x.i = row JOIN s5 y ON y.i = col")
def scaled_matrix(spark, sf):
    a = tb.supplier_part(spark, sf)
    return pt.scale(a, pt.ruiz(a)).select("row", "col", q("val").alias("val"))


@query(f"WITH {_sweeps(5)} SELECT {Q('max(abs(val) * x.r * y.c) * sqrt(2.220446049250313e-16) * 1e6')} AS threshold_1e6 FROM a JOIN s5 x ON x.i = row JOIN s5 y ON y.i = col")
def pivot_threshold(spark, sf):
    a = tb.supplier_part(spark, sf)
    return pt.pivot_threshold(a, pt.ruiz(a)).select(q(F.col("threshold") * 1e6).alias("threshold_1e6"))


@query(f"WITH {_sweeps(5)} SELECT {Q('sum(ln(r)) + sum(ln(c))')} AS log_scale FROM s5")
def scaling_log_product(spark, sf):
    return pt.ruiz(tb.supplier_part(spark, sf)).agg(q(F.sum(F.ln("scale"))).alias("log_scale"))


# Products and residuals.
def _ramp_rhs(spark, sf, **kw):
    a = tb.supplier_part(spark, sf)
    return a, pt.multiply(a, gen.ramp(spark, _n(spark, sf), kw.pop("rhs", 1)), **kw)


@query(f"WITH {SP}, x AS ({RAMP}) SELECT row AS idx, 0 AS rhs_id, {Q('sum(a.val * x.val)')} AS val FROM a JOIN x ON x.idx = a.col GROUP BY row")
def spmv(spark, sf):
    return _ramp_rhs(spark, sf)[1].select("idx", "rhs_id", q("val").alias("val"))


@query(f"WITH {SP}, x AS ({RAMP}) SELECT col AS idx, 0 AS rhs_id, {Q('sum(a.val * x.val)')} AS val FROM a JOIN x ON x.idx = a.row GROUP BY col")
def spmv_transpose(spark, sf):
    return _ramp_rhs(spark, sf, transpose=True)[1].select("idx", "rhs_id", q("val").alias("val"))


@query(f"WITH {SP}, x AS ({RAMP}) SELECT row AS idx, k AS rhs_id, {Q('sum(a.val * (x.val + k))')} AS val FROM a JOIN x ON x.idx = a.col CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) GROUP BY row, k")
def spmm(spark, sf):
    return _ramp_rhs(spark, sf, rhs=3)[1].select("idx", "rhs_id", q("val").alias("val"))


@query(f"WITH {SP}, x AS ({RAMP}), y AS (SELECT row, sum(a.val * x.val) AS v FROM a JOIN x ON x.idx = a.col GROUP BY row) SELECT {Q('sqrt(sum((1 - v) ** 2)) / sqrt(count(*))')} AS residual, 'numerical_issue' AS status FROM y")
def residual_norm(spark, sf):
    n = _n(spark, sf)
    ones = spark.range(n).select(F.col("id").alias("idx"), F.lit(0).alias("rhs_id"), F.lit(1.0).alias("val"))
    return pt.residual(tb.supplier_part(spark, sf), gen.ramp(spark, n), ones).select(q("residual").alias("residual"), "status")


# Matching.
@query("WITH c AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2) SELECT row, col, val, CAST(row_number() OVER (PARTITION BY col ORDER BY abs(val) DESC, row) AS INTEGER) AS rank FROM c WHERE val <> 0")
def matching_candidates(spark, sf):
    return pt.candidates(coo_assemble(spark, sf))


@query(f"WITH c AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2) SELECT row, col, {Q('ln(max(abs(val)) OVER (PARTITION BY col)) - ln(abs(val))')} AS cost FROM c WHERE val <> 0")
def mc64_costs(spark, sf):
    return pt.costs(coo_assemble(spark, sf)).select("row", "col", q("cost").alias("cost"))


def _five(spark):
    """A full 5 x 5 matrix of magnitudes over ten decades."""
    i, j = F.col("i"), F.col("j")
    v = F.pow(F.lit(10.0), ((i * 7 + j * 11 + i * j * 3) % 10 - 5).cast("double")) * (1 + ((i * 3 + j) % 4).cast("double") / 8)
    return spark.range(25).select((F.col("id") % 5).alias("j"), F.floor(F.col("id") / 5).alias("i")).select(i.alias("row"), j.alias("col"), v.alias("val"))


@query(f"""WITH RECURSIVE m AS (SELECT i, j, ln(10.0) * ((i * 7 + j * 11 + i * j * 3) % 10 - 5) + ln(1 + ((i * 3 + j) % 4) / 8.0) AS v FROM (SELECT unnest(range(0, 5)) AS i) CROSS JOIN (SELECT unnest(range(0, 5)) AS j)),
p AS (SELECT 0 AS k, 0 AS used, 0.0::DOUBLE AS s UNION ALL SELECT k + 1, used + (1 << i)::INTEGER, s + v FROM p JOIN m ON m.j = p.k WHERE (used >> i) & 1 = 0)
SELECT {Q('max(s)')} AS log_product FROM p WHERE k = 5""")
def mc64_log_product(spark, sf):
    a = _five(spark)
    match = so.run(a, None, LEVELLED.but(matching="mc64"), ("match",)).select(F.col("i").alias("col"), F.col("j").alias("row"))
    return a.join(match, ["row", "col"]).agg(q(F.sum(F.ln(F.abs("val")))).alias("log_product"))


@query("SELECT 1.0::DOUBLE AS largest, CAST(5 AS BIGINT) AS ones")
def mc64_scaled_max(spark, sf):
    a = _five(spark)
    parts = so.run(a, None, LEVELLED.but(matching="mc64", equilibrate=False), ("scale",))
    scales = parts.select(F.explode(rows_of("axis idx scale", (F.lit("row"), "i", "re"), (F.lit("col"), "i", "im"))).alias("s")).select("s.*")
    match = so.run(a, None, LEVELLED.but(matching="mc64"), ("match",)).select(F.col("i").alias("col"), F.col("j").alias("mrow"))
    matched = (F.abs(F.col("val") - 1) < 1e-9) & (F.col("row") == F.col("mrow"))
    return pt.scale(a, scales).join(match, "col").agg(q(F.max("val")).alias("largest"), F.count_if(matched).alias("ones"))


@query("SELECT * FROM (VALUES ('empty column', false), ('full', true)) t(system, perfect)")
def perfect_flag(spark, sf):
    base = spark.range(40).select(F.explode(rows_of("row col val", ("id", "id", F.lit(3.0)), (F.col("id") + 1, "id", F.lit(1.0)))).alias("e")).select("e.*").where("row < 40")
    both = base.withColumn("system_id", F.lit(1).cast("long")).union(base.where("col <> 17").withColumn("system_id", F.lit(0).cast("long")))
    r = so.report(so.run(both, None, LEVELLED, ("report",), n=40))
    return r.select(F.when(F.col("system_id") == 1, "full").otherwise("empty column").alias("system"), F.col("matching_perfect").alias("perfect"))


@query("WITH p AS (SELECT i, (i * 37 + 11) % 101 AS v FROM (SELECT unnest(range(0, 101)) AS i)) SELECT CAST(CASE WHEN count(*) % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS sign FROM p a JOIN p b ON a.i < b.i AND a.v > b.v")
def perm_parity(spark, sf):
    return so.parity_of(spark.range(101).select(F.col("id").alias("orig"), ((F.col("id") * 37 + 11) % 101).alias("internal")))


# Symbolic: natural order of a 10 x 10 grid, whose fill SQL finds by paths through smaller vertices.
PATHS = """WITH RECURSIVE e AS (SELECT y * 10 + x AS s, y * 10 + x + d AS t FROM (SELECT unnest(range(0, 10)) AS x) CROSS JOIN (SELECT unnest(range(0, 10)) AS y) CROSS JOIN (VALUES (1), (-1), (10), (-10)) o(d)
  WHERE (d = 1 AND x < 9) OR (d = -1 AND x > 0) OR (d = 10 AND y < 9) OR (d = -10 AND y > 0)),
reach AS (SELECT s AS j, t AS v FROM e UNION SELECT r.j, e.t FROM reach r JOIN e ON e.s = r.v WHERE r.v < r.j),
fill AS (SELECT DISTINCT j, v AS i FROM reach WHERE v > j),
tree AS (SELECT n.j, coalesce(min(f.i), -1) AS parent, count(f.i) AS below FROM (SELECT unnest(range(0, 100)) AS j) n LEFT JOIN fill f ON f.j = n.j GROUP BY n.j)"""
PLAIN = LEVELLED.but(ordering="natural", matching="none", relaxed_width=0, max_zero_rows=-1, fill_fraction=-1.0, max_block=0)


def _ten(spark, part, options=PLAIN):
    return so.run(gen.laplacian2d(spark, 10, 10), None, options, (part,))


@query(f"{PATHS} SELECT CAST(j AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent FROM tree")
def etree(spark, sf):
    return _ten(spark, "etree").select(F.col("i").alias("node"), F.col("j").alias("parent"))


@query(f"{PATHS} SELECT CAST(j AS BIGINT) AS node, CAST(below AS BIGINT) AS below FROM tree")
def column_counts(spark, sf):
    return _ten(spark, "etree").select(F.col("i").alias("node"), F.col("k").alias("below"))


@query(f"{PATHS} SELECT CAST(sum(below) + 100 AS BIGINT) AS nnz_l, CAST(sum(below) + 100 AS BIGINT) AS nnz_u FROM tree")
def factor_nnz(spark, sf):
    return so.report(_ten(spark, "report", PLAIN.but(max_block=1))).select("nnz_l", "nnz_u")


SUPER = PATHS + """, kids AS (SELECT parent AS j, count(*) AS k FROM tree GROUP BY parent),
cut AS (SELECT t.j, t.below, CASE WHEN p.parent = t.j AND p.below = t.below + 1 AND k.k = 1 THEN 0 ELSE 1 END AS new FROM tree t LEFT JOIN tree p ON p.j = t.j - 1 LEFT JOIN kids k ON k.j = t.j),
sn AS (SELECT j, below, sum(new) OVER (ORDER BY j) - 1 AS s FROM cut),
node AS (SELECT s, min(j) AS f, max(j) AS l, min(below) AS r FROM sn GROUP BY s)"""


@query(f"{SUPER} SELECT CAST(s AS BIGINT) AS sn, CAST(f AS BIGINT) AS first_col, CAST(l AS BIGINT) AS last_col, CAST(r AS BIGINT) AS off_rows FROM node")
def fundamental_supernodes(spark, sf):
    return _ten(spark, "supernode").select(F.col("i").alias("sn"), F.col("j").alias("first_col"), F.col("k").alias("last_col"), F.col("re").cast("long").alias("off_rows"))


BLOCKS = SUPER + """, rows AS (SELECT n.s, f.i, t.s AS facing FROM node n JOIN fill f ON f.j = n.l JOIN sn t ON t.j = f.i),
grp AS (SELECT s, i, facing, i - row_number() OVER (PARTITION BY s, facing ORDER BY i) AS g FROM rows),
blk AS (SELECT s, facing, min(i) AS a, max(i) AS b FROM grp GROUP BY s, facing, g)"""


@query(f"{BLOCKS} SELECT CAST(s AS BIGINT) AS sn, CAST(row_number() OVER (PARTITION BY s ORDER BY a) - 1 AS BIGINT) AS block, CAST(a AS BIGINT) AS first_row, CAST(b AS BIGINT) AS last_row, CAST(facing AS BIGINT) AS facing_sn FROM blk")
def row_blocks(spark, sf):
    return _ten(spark, "block").select(F.col("i").alias("sn"), F.col("j").alias("block"), F.col("k").alias("first_row"), F.col("re").cast("long").alias("last_row"), F.col("im").cast("long").alias("facing_sn"))


@query(f"{BLOCKS}, nb AS (SELECT s, facing, row_number() OVER (PARTITION BY s ORDER BY a) - 1 AS b FROM blk) SELECT CAST(facing AS BIGINT) AS target_sn, CAST(s AS BIGINT) AS source_sn, CAST(min(b) AS BIGINT) AS block FROM nb GROUP BY facing, s")
def update_sources(spark, sf):
    return _ten(spark, "source").select(F.col("i").alias("target_sn"), F.col("j").alias("source_sn"), F.col("k").alias("block"))


@query(f"{BLOCKS}, lv AS (SELECT s, 0 AS l FROM node UNION SELECT b.facing, lv.l + 1 FROM lv JOIN blk b ON b.s = lv.s) SELECT CAST(s AS BIGINT) AS sn, CAST(max(l) AS BIGINT) AS level FROM lv GROUP BY s")
def levels(spark, sf):
    return _ten(spark, "supernode").select(F.col("i").alias("sn"), F.col("im").cast("long").alias("level"))


@query(f"{BLOCKS} SELECT CAST(s AS BIGINT) AS source_sn, CAST(facing AS BIGINT) AS consumer_sn FROM (SELECT DISTINCT s, facing FROM blk)")
def consumers(spark, sf):
    return _ten(spark, "source").select(F.col("j").alias("source_sn"), F.col("i").alias("consumer_sn"))


@query("SELECT * FROM (VALUES ('min_degree', true), ('dissection', true), ('auto', true)) t(ordering, under_half)")
def ordering_fill_ratio(spark, sf):
    """Fill under half of the natural order's: a wrong direction would show here."""
    a = gen.laplacian3d(spark, 12, 12, 12)
    natural = so.report(so.run(a, None, LEVELLED.but(ordering="natural"), ("report",))).select(F.col("nnz_l").alias("base"))
    out = None
    for kind in ("min_degree", "dissection", "auto"):
        one = so.report(so.run(a, None, LEVELLED.but(ordering=kind, max_factor_nonzeros=1), ("report",))).select(F.lit(kind).alias("ordering"), "nnz_l")
        out = one if out is None else out.union(one)
    return out.join(F.broadcast(natural)).select("ordering", (F.col("nnz_l") < 0.5 * F.col("base")).alias("under_half"))


@query(f"WITH {SP}, t AS (SELECT s, p, (SELECT count(*) FROM pair) AS e FROM sc, pc) SELECT CAST(p + s + e + s * (s - 1) / 2 AS BIGINT) AS nnz_l FROM t")
def sp_fill(spark, sf):
    """Parts first: every part is eliminated without fill and the suppliers end in one full block."""
    a = tb.supplier_part(spark, sf)
    return so.report(so.run(a, None, PLAIN.but(max_factor_nonzeros=1, max_block=1), ("report",))).select("nnz_l")


@query("SELECT 'numerical_issue' AS status, false AS factorized")
def fill_guard(spark, sf):
    b = gen.ramp(spark, 100)
    return so.report(so.run(gen.laplacian2d(spark, 10, 10), b, LEVELLED.but(max_factor_nonzeros=100), ("report",))).select("status", "factorized")


# Determinants: elimination in SQL.
ELIM = """WITH RECURSIVE em AS (SELECT i - 1 AS i, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)),
vecs AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS v FROM vecs a JOIN vecs b USING (vec_id) GROUP BY a.i, b.i),
e AS (SELECT 0 AS k, i, j, v FROM g UNION ALL
      SELECT e.k + 1, e.i, e.j, e.v - c.v * r.v / p.v FROM e JOIN e c ON c.i = e.i AND c.j = e.k JOIN e r ON r.i = e.k AND r.j = e.j JOIN e p ON p.i = e.k AND p.j = e.k WHERE e.i > e.k AND e.j > e.k),
piv AS (SELECT k, v FROM e WHERE i = k AND j = k)"""


@query(f"{ELIM} SELECT {Q('sum(ln(abs(v)))')} AS log_abs_det, CASE WHEN count(*) FILTER (WHERE v < 0) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS det_sign FROM piv")
def log_abs_det(spark, sf):
    return so.report(so.run(tb.ridge(spark, sf)[0], None, LEVELLED, ("report",))).select(q("log_abs_det").alias("log_abs_det"), "det_sign")


@query(f"{ELIM} SELECT CAST(k AS BIGINT) AS k, {Q('v')} AS pivot FROM piv")
def lu_pivots(spark, sf):
    plain = PLAIN.but(equilibrate=False, pivoting="none", pivot_threshold=0.0)
    return so.run(tb.ridge(spark, sf)[0], None, plain, ("diag",)).select(F.col("i").alias("k"), q("re").alias("pivot"))


@query("SELECT * FROM (VALUES (0, -1.0::DOUBLE), (1, 1.0::DOUBLE)) t(system_id, det_sign)")
def det_sign(spark, sf):
    """150 I and the same with one sign turned: the determinant overflows, its logarithm and sign do not."""
    a = spark.range(300).select(F.floor(F.col("id") / 150).alias("system_id"), (F.col("id") % 150).alias("row"), (F.col("id") % 150).alias("col"), F.when(F.col("id") == 0, -150.0).otherwise(150.0).alias("val"))
    return so.report(so.run(a, None, LEVELLED, ("report",))).select(F.col("system_id").cast("int").alias("system_id"), "det_sign")


@query("WITH RECURSIVE d AS (SELECT 1 AS n, 4.0::DOUBLE AS a, 1.0::DOUBLE AS b UNION ALL SELECT n + 1, 4 * a - b, a FROM d WHERE n < 8) SELECT floor(a + 0.5) AS det FROM d WHERE n = 8")
def determinant(spark, sf):
    """A chain of 8: 4 on the diagonal, 1 beside it; the determinant follows a recurrence."""
    r = so.report(so.run(gen.laplacian2d(spark, 8, 1), None, LEVELLED, ("report",)))
    return r.select(F.floor(F.col("det_sign") * F.exp("log_abs_det") + 0.5).cast("double").alias("det"))


# Solutions: b = A x for a known x.
XS = f"WITH {SP}, x AS ({RAMP}) SELECT idx, 0 AS rhs_id, {Q('val')} AS val FROM x"
GRID_X = "SELECT i AS idx, 0 AS rhs_id, CAST(1 + 0.25 * (i % 5) AS DOUBLE) AS val FROM (SELECT unnest(range(0, {n})) AS i)"


def _x(df: DataFrame) -> DataFrame:
    return df.select("idx", "rhs_id", q("val").alias("val"))


def _made(spark, a, n, options, x=None, trans="N", **more):
    x = gen.ramp(spark, n) if x is None else x
    a = checkpoint(a) if more.get("split") else a  # read twice, for b and for the solution
    return _x(so.solve(a, pt.multiply(a, x, transpose=trans != "N"), options, trans=trans, n=n, **more))


@query(XS)
def solve_sp(spark, sf):
    n = _n(spark, sf)
    return _made(spark, tb.supplier_part(spark, sf), n, LEVELLED, split=True)


@query(f"WITH {SP}, x AS ({RAMP}) SELECT idx, k AS rhs_id, {Q('val + k')} AS val FROM x CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k)")
def solve_multi_rhs(spark, sf):
    n = _n(spark, sf)
    return _made(spark, tb.supplier_part(spark, sf), n, LEVELLED, gen.ramp(spark, n, 4), split=True)


@query(XS)
def solve_transpose(spark, sf):
    n = _n(spark, sf)
    return _made(spark, tb.supplier_part(spark, sf), n, LEVELLED, trans="T", split=True)


@query(XS)
def solve_mc64(spark, sf):
    n = _n(spark, sf)
    return _made(spark, tb.supplier_part(spark, sf), n, DYNAMIC.but(matching="mc64"), split=True)


@query(GRID_X.format(n=400))
def solve_unsymmetric(spark, sf):
    return _made(spark, gen.upwind2d(spark, 20, 20), 400, DYNAMIC)


@query(GRID_X.format(n=500))
def solve_weak_diagonal(spark, sf):
    return _made(spark, gen.weak_diagonal(spark, 500, 3), 500, LEVELLED)


@query(GRID_X.format(n=3600))
def solve_grid(spark, sf):
    return _made(spark, gen.laplacian2d(spark, 60, 60), 3600, LEVELLED.but(ordering="auto"))


@query("SELECT i AS idx, 0 AS rhs_id, floor((1 + 0.5 * sin(i)) * 1e6 + 0.5) / 1e6 AS val FROM (SELECT unnest(range(0, 400)) AS i)")
def solve_random(spark, sf):
    return _made(spark, gen.random_unsymmetric_pattern(spark, 400, 0.02, 5), 400, DYNAMIC.but(ordering="column_degree"), gen.sine(spark, 400))


@query(GRID_X.format(n=80))
def solve_refactorized(spark, sf):
    """Analyzed on a grid, factored with other values of the same pattern."""
    a = gen.laplacian2d(spark, 10, 8)
    b = a.select("row", "col", F.when(F.col("row") == F.col("col"), 17 + 0.5 * F.col("row")).otherwise(-0.25).alias("val"))
    return _x(so.solve(a, pt.multiply(b, gen.ramp(spark, 80)), LEVELLED, values=b))


@query("SELECT i AS idx, floor((1 + 0.01 * i) * 1e6 + 0.5) / 1e6 AS re, floor((0.5 - 0.003 * i) * 1e6 + 0.5) / 1e6 + 0.0 AS im FROM (SELECT unnest(range(0, 150)) AS i)")
def solve_adjoint_complex(spark, sf):
    """A complex system solved with its adjoint; b = Aᴴ x by two joins of real parts."""
    a = gen.random_symmetric_pattern(spark, 150, 0.05, 4).toDF("row", "col", "re").withColumn("im", 0.3 * (2 * gen.uniform(8, F.col("row"), F.col("col")) - 1))
    x = spark.range(150).select(F.col("id").alias("row"), (1 + 0.01 * F.col("id")).alias("xr"), (0.5 - 0.003 * F.col("id")).alias("xi"))
    b = a.join(x, "row").groupBy(F.col("col").alias("idx")).agg(F.sum(F.col("re") * F.col("xr") + F.col("im") * F.col("xi")).alias("re"), F.sum(F.col("re") * F.col("xi") - F.col("im") * F.col("xr")).alias("im"))
    out = so.solve(a, b.withColumn("rhs_id", F.lit(0)), LEVELLED.but(dtype="complex128"), trans="H", n=150)
    return out.select("idx", q("val").alias("re"), q("im").alias("im"))


@query("SELECT i AS idx, 0 AS rhs_id, CAST(1 + 0.25 * (i % 5) AS DOUBLE) AS val FROM (SELECT unnest(range(0, 100)) AS i)")
def solve_float32(spark, sf):
    a = gen.laplacian2d(spark, 10, 10)
    out = so.solve(a, pt.multiply(a, gen.ramp(spark, 100)), LEVELLED.but(dtype="float32", refinement="none", failure_threshold=1e-4))
    return out.select("idx", "rhs_id", (F.floor(F.col("val") * 100 + 0.5) / 100).alias("val"))


@query(GRID_X.format(n=100))
def solve_lu_access(spark, sf):
    """L, then U, by two separate sweeps in internal numbering, on the unscaled natural grid."""
    a, plain = gen.laplacian2d(spark, 10, 10), PLAIN.but(equilibrate=False, pivoting="none")
    y = so.solution(so.run(a, pt.multiply(a, gen.ramp(spark, 100)), plain, ("l_solve",)), "l_solve")
    return _x(so.solution(so.run(a, y.select("idx", "rhs_id", "val"), plain, ("u_solve",)), "u_solve"))




def _markov() -> str:
    """x = (I + M)(I + M^2)(I + M^4)... 1 with M = 0.85 Pᵀ for each user: 256 terms of the series."""
    out = ["""ev AS (SELECT user_id AS u, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
st AS (SELECT u, a, b, count(*) AS c FROM ev WHERE b IS NOT NULL GROUP BY ALL),
m0 AS (SELECT u, y.k AS i, x.k AS j, 0.85 * c / sum(c) OVER (PARTITION BY u, a) AS v FROM st JOIN kinds x ON x.event_type = a JOIN kinds y ON y.event_type = b),
x0 AS (SELECT u, k AS i, 1.0::DOUBLE AS v FROM (SELECT DISTINCT user_id AS u FROM events), kinds)"""]
    for k in range(8):
        out.append(f"x{k + 1} AS (SELECT x.u, x.i, x.v + coalesce(y.v, 0) AS v FROM x{k} x LEFT JOIN (SELECT m.u, m.i, sum(m.v * x.v) AS v FROM m{k} m JOIN x{k} x ON x.u = m.u AND x.i = m.j GROUP BY m.u, m.i) y ON y.u = x.u AND y.i = x.i)")
        out.append(f"m{k + 1} AS (SELECT a.u, a.i, b.j, sum(a.v * b.v) AS v FROM m{k} a JOIN m{k} b ON b.u = a.u AND b.i = a.j GROUP BY a.u, a.i, b.j)")
    return ", ".join(out)


@query(f"WITH {_markov()} SELECT u AS system_id, CAST(i AS BIGINT) AS idx, {Q('v')} AS val FROM x8")
def solve_batched_markov(spark, sf):
    """One small system for each user: expected discounted visits x = 1 + 0.85 Pᵀ x. """
    a = tb.event_chains(spark, sf)
    b = a.select("system_id", F.col("row").alias("idx")).distinct().select("system_id", "idx", F.lit(0).alias("rhs_id"), F.lit(1.0).alias("val"))
    return so.solve(a, b, LEVELLED).select("system_id", "idx", q("val").alias("val"))


@query("SELECT user_id AS system_id, true AS solved FROM (SELECT DISTINCT user_id FROM events)")
def markov_residuals(spark, sf):
    """Every user's solution put back into its equations by joins."""
    a = tb.event_chains(spark, sf)
    b = a.select("system_id", F.col("row").alias("idx")).distinct().select("system_id", "idx", F.lit(0).alias("rhs_id"), F.lit(1.0).alias("val"))
    ax = pt.multiply(a, so.solve(a, b, LEVELLED).select("system_id", "idx", "rhs_id", "val"))
    return ax.groupBy("system_id").agg((F.max(F.abs(F.col("val") - 1)) < 1e-9).alias("solved"))


@query("""WITH v AS (SELECT vec_id, CAST(label AS INTEGER) AS l, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT CAST(i AS BIGINT) AS idx, l AS rhs_id, floor(sum(v) * 1e4 + 0.5) / 1e4 + 0.0 AS val FROM v GROUP BY i, l""")
def ridge_fit(spark, sf):
    """Ridge coefficients of every label, multiplied back: A x is the right-hand side."""
    a, b = tb.ridge(spark, sf)
    x = so.solve(a, b, LEVELLED).select("idx", "rhs_id", "val")
    return pt.multiply(a, x).select("idx", "rhs_id", (F.floor(F.col("val") * 1e4 + 0.5) / 1e4 + 0.0).alias("val"))


# Status.
def _dead(spark, broken: bool):
    a = gen.random_symmetric_pattern(spark, 80, 0.1, 2).toDF("row", "col", "val")
    return a.where("row <> 40 AND col <> 40") if broken else a


@query("SELECT 'numerical_issue' AS status")
def honest_failure(spark, sf):
    b = gen.ramp(spark, 80)
    return so.report(so.run(_dead(spark, True), b, LEVELLED, ("report",), n=80)).select("status")


@query("SELECT * FROM (VALUES (0, 'numerical_issue'), (1, 'success')) t(system_id, status)")
def status_recovers(spark, sf):
    both = _dead(spark, True).withColumn("system_id", F.lit(0).cast("long")).union(_dead(spark, False).withColumn("system_id", F.lit(1).cast("long")))
    b = gen.ramp(spark, 80).join(spark.range(2).withColumnRenamed("id", "system_id"))
    return so.report(so.run(both, b, LEVELLED, ("report",), n=80)).select(F.col("system_id").cast("int").alias("system_id"), "status")


@query("SELECT 'success' AS status, 0.0::DOUBLE AS residual")
def zero_rhs(spark, sf):
    b = spark.range(100).select(F.col("id").alias("idx"), F.lit(0).alias("rhs_id"), F.lit(0.0).alias("val"))
    return so.report(so.run(gen.laplacian2d(spark, 10, 10), b, LEVELLED, ("report",))).select("status", "residual")


def _refined(spark, options):
    a = gen.weak_diagonal(spark, 300, 6)
    return so.report(so.run(a, pt.multiply(a, gen.ramp(spark, 300)), options, ("report",)))


@query("SELECT true AS accurate")
def refine_stationary(spark, sf):
    return _refined(spark, LEVELLED.but(refinement="stationary", matching="none")).select((F.col("residual") < 1e-8).alias("accurate"))


@query("SELECT true AS accurate")
def refine_bicgstab(spark, sf):
    return _refined(spark, LEVELLED.but(refinement="bicgstab", matching="none")).select((F.col("residual") < 1e-10).alias("accurate"))


@query("SELECT CAST(0 AS INTEGER) AS refine_iterations, CAST(0 AS BIGINT) AS replaced_pivots")
def refine_gate(spark, sf):
    """Nothing was replaced, so nothing is refined."""
    a = gen.upwind2d(spark, 12, 12)
    return so.report(so.run(a, pt.multiply(a, gen.ramp(spark, 144)), DYNAMIC, ("report",))).select("refine_iterations", "replaced_pivots")


# Comparison and reports.
OLD = "(VALUES ('grid', 'a', 100, 1e-16, 5.0), ('chain', 'a', 50, 1e-12, 1.0), ('lost', 'b', -1, 0.0, 0.0), ('slow', 'b', 80, 1e-15, 1.0)) o(matrix, solver, nnz_l, resid, time_ms)"
NEW = "(VALUES ('grid', 'a', 103, 2e-16, 6.0), ('chain', 'a', 60, 1e-12, 1.0), ('lost', 'b', 10, 0.0, 0.0), ('slow', 'b', 80, 1e-5, 9.0), ('new', 'a', 5, 1e-16, 1.0)) n(matrix, solver, nnz_l, resid, time_ms)"


@query(f"""SELECT n.matrix, n.solver, CASE WHEN o.matrix IS NULL THEN 'new' WHEN (o.nnz_l < 0) <> (n.nnz_l < 0) THEN 'flipped' WHEN abs(n.nnz_l - o.nnz_l) > 0.05 * o.nnz_l THEN 'fill'
WHEN n.resid > greatest(1e-6, 10 * o.resid) THEN 'residual' WHEN n.time_ms > 3 * o.time_ms THEN 'time' ELSE 'same' END AS verdict FROM {NEW} LEFT JOIN {OLD} USING (matrix, solver)""")
def baseline_compare(spark, sf):
    return cmp.against_baseline(spark.sql(f"SELECT * FROM {OLD.split(' o(')[0]} AS o(matrix, solver, nnz_l, resid, time_ms)"), spark.sql(f"SELECT * FROM {NEW.split(' n(')[0]} AS n(matrix, solver, nnz_l, resid, time_ms)"))


@query("SELECT * FROM (VALUES ('sym', CAST(1 AS BIGINT)), ('partial', 1), ('unsym', 2)) t(band, n)")
def corpus_bands(spark, sf):
    return cmp.band_counts(spark.createDataFrame([(1.0,), (0.7,), (0.2,), (0.0,)], "psym double"))


@query("SELECT * FROM (VALUES ('solved', CAST(1 AS BIGINT)), ('flagged', 1), ('declined', 1)) t(outcome, n)")
def outcome_counts(spark, sf):
    ok = _dead(spark, False).withColumn("system_id", F.lit(0).cast("long"))
    bad = _dead(spark, True).withColumn("system_id", F.lit(1).cast("long"))
    b = gen.ramp(spark, 80).join(spark.range(2).withColumnRenamed("id", "system_id"))
    r = so.report(so.run(ok.union(bad), b, LEVELLED, ("report",), n=80))
    big = so.report(so.run(gen.laplacian2d(spark, 10, 10), gen.ramp(spark, 100), LEVELLED.but(max_factor_nonzeros=10), ("report",)))
    return cmp.outcomes(r.union(big))


@query("SELECT * FROM (VALUES ('factor', 'b', 2.0::DOUBLE), ('solve', 'a', 1.0::DOUBLE)) t(phase, config, best_ms)")
def best_times(spark, sf):
    rows = [("a", "factor", 0, 9.0), ("a", "factor", 1, 3.0), ("b", "factor", 1, 2.0), ("a", "solve", 1, 1.0), ("b", "solve", 1, 4.0), ("b", "solve", 0, 0.5)]
    return cmp.best_of(spark.createDataFrame(rows, "config string, phase string, run int, ms double"))


@query(f"{PATHS} SELECT CAST(k AS BIGINT) AS system_id, 'success' AS status, CAST(below AS BIGINT) AS nnz_l FROM (SELECT sum(below) + 100 AS below FROM tree) CROSS JOIN (SELECT unnest(range(0, 8)) AS k)")
def concurrency_ceiling(spark, sf):
    """K independent factorizations, one group each."""
    a = gen.laplacian2d(spark, 10, 10).join(spark.range(8).withColumnRenamed("id", "system_id"))
    return so.report(so.run(a, None, PLAIN.but(max_block=1), ("report",))).select("system_id", "status", "nnz_l")


@query("SELECT * FROM (VALUES ('levelled', true), ('dynamic', true)) t(solver, agrees)")
def solver_comparison(spark, sf):
    """Both presets on one system against the known solution."""
    a, x = gen.laplacian2d(spark, 20, 20), gen.ramp(spark, 400)
    b, out = pt.multiply(a, x), None
    for name, o in (("levelled", LEVELLED), ("dynamic", DYNAMIC)):
        y = so.solve(a, b, o).select("idx", "rhs_id", F.col("val").alias("y"))
        one = y.join(x, ["idx", "rhs_id"]).agg((F.max(F.abs(F.col("y") - F.col("val"))) < 1e-8).alias("agrees")).select(F.lit(name).alias("solver"), "agrees")
        out = one if out is None else out.union(one)
    return out


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), 2.5::DOUBLE), (1, 0, -1.0), (2, 2, 7.0)) t(row, col, val)")
def matrixmarket_lines(spark, sf):
    text = ["%%MatrixMarket matrix coordinate real general", "% a note", "", "3 3 3", "1 1 2.5", " 2  1 -1.0\r", "3 3 7"]
    from lumenfold.sources.matrixmarket import parse_lines

    return parse_lines(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
