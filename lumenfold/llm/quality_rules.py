"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.store import Tables

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a base text, and the most of 100 words that may lie in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A rule rejects values above its cutoff; cutoffs run from lenient to strict and are fixed before any label is seen.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "capitals": ("n_upper / greatest(word_chars, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "word_length": ("word_chars / greatest(n_words, 1)", [40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0]),
}
#: Clean documents of a stratum that all its rules together may reject, and the chance that any stated bound fails.
RISK, DELTA = 0.02, 0.05
#: Terms of a binomial tail that are summed; the rest is bounded from above by a geometric series.
TERMS = 10_000
#: Rows up to which a table with a row for each stratum (and rule) is held by the driver.
FEW = 10_000


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: 64-bit window names, sorted to find the repeated, then mapped to places.

    Repeated windows start at p1 < p2 < ...; each covers min(3, distance to the next) words of its own.
    """

    def of_places(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def of_names(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))

            def of_repeated(d: Column) -> Column:
                few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

                def of_pairs(q: Column) -> Column:
                    hit = F.filter(q, lambda x, i: F.coalesce((x["h"] == F.get(q, i - 1)["h"]) | (x["h"] == F.get(q, i + 1)["h"]), x["h"] == F.get(q, i - 1)["h"], x["h"] == F.get(q, i + 1)["h"]))
                    return F.sort_array(F.transform(hit, lambda x: x["i"]))

                many = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_pairs)
                return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 16, let(few, of_places)).otherwise(let(many, of_places))

            return let(twice, of_repeated)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), of_sorted))

    names = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(names, of_names)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base columns of every whole text (null: no words), beside the given columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    cols = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n = F.char_length(text)
    out = docs.select(
        "*",
        cols.alias("__w"),
        of_lines.alias("__l"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (n - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("*", F.col("__w.n_words"), F.col("__w.n_repeat_words"), F.col("__l.n_lines"), F.col("__l.n_dup_lines")).drop("__w", "__l").withColumn("base_failed", base)


def _log_factorial(x: str) -> str:
    """SQL for ln x!, exact to 1e-12: Stirling's series at x + 10."""
    y = f"(({x}) + 10D)"
    down = " + ".join(f"ln(({x}) + {j}D)" for j in range(1, 11))
    return f"(({y} + 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - 1D / (1680D * pow({y}, 7)) - ({down}))"


def binomial_at_most(k: str, n: str, p: float, terms: int = TERMS) -> str:
    """SQL for P(X <= k), X ~ Binomial(n, p), for k below n p: log terms, summed.

    Beyond ``terms`` terms the rest is bounded by a geometric series (each term is at most r times the next, r as between the last two), so the value errs upwards only: a
    cutoff is never certified for want of terms.
    """
    term = lambda j: f"exp({_log_factorial(n)} - {_log_factorial(j)} - {_log_factorial(f'({n}) - {j}')} + {j} * ln({p}D) + (({n}) - {j}) * ln({1 - p}D))"
    low = f"greatest(CAST(0 AS BIGINT), {k} - {terms - 1})"
    ratio = f"(({k}) * {1 - p}D / ((({n}) - ({k}) + 1) * {p}D))"
    rest = f"CASE WHEN {low} > 0 THEN {term(f'({low} - 1)')} / greatest(1D - {ratio}, 1e-300D) ELSE 0D END"
    return f"(aggregate(sequence({low}, {k}), 0D, (a, j) -> a + {term('j')}) + {rest})"


def chooses(id_value: Column) -> Column:
    """Whether a labelled document helps to choose cutoffs (else to certify them): half of them, by a digest of the id."""
    return F.substring(F.md5(id_value.cast("string").cast("binary")), 1, 1) < "8"


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff, place, tested, false_rejected, caught``: the certified rules of each stratum, if any.

    Labelled documents that pass the base rules are dealt into two halves. The first chooses: of each rule the cutoff that catches
    most bad documents while it rejects at most ``risk`` / (2 x rules) of the clean ones (the most lenient of equals), and the order of the rules by
    what they catch. The second certifies the rules one after another, each together with all before it: a rule enters if, were the true
    joint false rejection of the stratum ``risk``, so few clean documents rejected would have a chance of at most ``delta`` / strata (the exact binomial
    bound, Bonferroni over the strata); the first that fails ends the sequence, so the order needs no further correction. With chance
    1 - ``delta``, no stratum loses more than ``risk`` of its clean documents to all its rules together.
    ``false_rejected`` counts, of the ``tested`` clean documents of the second half, those that the rules up to this one reject.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)").distinct()
    values = F.struct(*[F.expr(expr).alias(r) for r, (expr, _) in RULES.items()]).alias("v")
    both = measured.where(~F.col("base_failed")).withColumn("__stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(known, F.col(id_col) == F.col("__id"))
    seen = both.select("__stratum", "__label", values, chooses(F.col("__id")).alias("chooses"))
    tried = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("number"), F.lit(j).alias("step"), F.lit(c).alias("cutoff"), (F.col(f"v.{r}") > c).alias("out")) for i, (r, (_, cuts)) in enumerate(RULES.items()) for j, c in enumerate(cuts)])
    clean, bad = F.col("__label") == 1, F.col("__label") == 0
    counts = seen.where("chooses").select("__stratum", "__label", F.explode(tried).alias("t")).groupBy("__stratum", "t.rule", "t.number", "t.step", "t.cutoff").agg(
        F.count_if(clean).alias("n"), F.count_if(clean & F.col("t.out")).alias("k"), F.count_if(bad & F.col("t.out")).alias("caught")
    )
    fit = counts.where((F.col("caught") > 0) & (F.col("k") <= F.col("n") * (risk / (2 * len(RULES)))))
    best = fit.groupBy("__stratum", "rule", "number").agg(F.max_by(F.struct("cutoff", "caught"), F.struct("caught", -F.col("step"))).alias("b"))
    path = best.selectExpr("__stratum", "rule", "b.cutoff AS cutoff", "b.caught AS caught", "row_number() OVER (PARTITION BY __stratum ORDER BY b.caught DESC, number) AS place")
    path = path.sparkSession.createDataFrame(path.collect(), path.schema) if path.limit(FEW + 1).count() <= FEW else path
    wide = path.groupBy("__stratum").agg(*[F.max(F.when(F.col("rule") == r, F.struct("cutoff", "place"))).alias(f"r_{r}") for r in RULES])
    first = F.least(F.lit(len(RULES) + 1), *[F.when(F.col(f"v.{r}") > F.col(f"r_{r}.cutoff"), F.col(f"r_{r}.place")) for r in RULES])
    held = seen.where(~F.col("chooses") & clean).join(wide, "__stratum").withColumn("first", first)
    tested = held.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("first") <= m) for m in range(1, len(RULES) + 1)]).alias("ks"))
    strata = max(1, seen.select("__stratum").distinct().count())
    each = path.join(tested, "__stratum").withColumn("k", F.expr("get(ks, place - 1)"))
    sure = F.expr(f"CASE WHEN n = 0 OR k >= n * {risk}D THEN false ELSE {binomial_at_most('k', 'n', risk)} <= {delta / strata}D END")
    chain = each.withColumn("sure", sure).selectExpr("*", "min(sure) OVER (PARTITION BY __stratum ORDER BY place) AS certified")
    return chain.where("certified").select(F.col("__stratum").alias("stratum"), "rule", "cutoff", "place", F.col("n").alias("tested"), F.col("k").alias("false_rejected"), "caught")


def _cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row a stratum, a column a rule; broadcast only when it has at most FEW rows."""
    found = thresholds(measured, labels, id_col, label_col, "__lang").groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cut = found.select("stratum", *[F.col(r).alias(f"__{r}") for r in RULES])
    few = cut.limit(FEW + 1).collect()
    return F.broadcast(measured.sparkSession.createDataFrame(few, cut.schema)) if len(few) <= FEW else cut


def _judged(measured: DataFrame, cut: DataFrame) -> DataFrame:
    out = measured.join(cut, F.coalesce("__lang", F.lit("")) == F.col("stratum"), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(f"{expr} > __{r}"), F.lit(r)) for r, (expr, _) in RULES.items()]))
    out = out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("stratum", "__lang", *[f"__{r}" for r in RULES])


def _narrow(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    return measure(docs.select(F.col(id_col), F.col(stratum_col).cast("string").alias("__lang"), F.col(text_col).alias("__text")), id_col, "__text").drop("__text")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Every document with its base columns, ``base_failed``, ``failed_rules`` and ``kept``.

    A document is kept if it passes the base rules and no certified rule of its stratum rejects it: see ``thresholds``. A null or empty text has no
    words and fails; a null stratum is a stratum of its own; labels with nulls or for unknown ids do not count, and an id labelled
    both ways counts as both. Without labels no cutoff is certified. An empty table gives no rows; other columns are not read.
    """
    measured = Tables(docs.sparkSession, "quality").keep(_narrow(docs, id_col, text_col, stratum_col))
    return _judged(measured, _cutoffs(measured, labels, id_col, label_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are measured twice, once for the cutoffs and once to filter, so that none is written or shuffled. Of the first pass only
    rows with a label are kept; they come from a shuffle of their numbers, so they need few files.
    """
    known = labels.select(F.col(id_col).alias("__known")).where("__known IS NOT NULL").distinct()
    narrow = _narrow(docs, id_col, text_col, stratum_col)
    measured = Tables(docs.sparkSession, "quality").keep(narrow.join(known, F.col(id_col) == F.col("__known")).drop("__known"))
    cut = _cutoffs(measured, labels, id_col, label_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(stratum_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    judged = _judged(measure(row, "__row", "__text"), cut)
    # As one condition on both sides of the join; "kept" is two, of which Spark would work out the first, with all it measures, below the join again.
    failed = F.concat(F.array(F.when(F.col("base_failed"), F.lit(""))), "failed_rules")
    return judged.where(F.size(F.array_compact(failed)) == 0).select("__row.*")


def _oracle() -> str:
    """The same in DuckDB SQL, by window counts and lgamma."""
    values = ", ".join(f"{expr} AS {r}" for r, (expr, _) in RULES.items())
    tried = " UNION ALL ".join(f"SELECT stratum, label, '{r}' AS rule, {i} AS number, {j} AS step, {c}::DOUBLE AS cutoff, {r} > {c}::DOUBLE AS out FROM chosen" for i, (r, (_, cuts)) in enumerate(RULES.items()) for j, c in enumerate(cuts))
    tail = f"list_sum([exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({RISK}) + (n - j) * ln({1 - RISK})) FOR j IN range(0, k + 1)])"
    ruled = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {i} AS number, {r} AS value FROM v" for i, r in enumerate(RULES))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
v AS (SELECT *, {values} FROM b),
seen AS (SELECT v.*, quality AS label, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS chooses FROM v JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) USING (doc_id) WHERE NOT base_failed),
chosen AS (SELECT * FROM seen WHERE chooses),
tried AS ({tried}),
counts AS (SELECT stratum, rule, number, step, cutoff, count(*) FILTER (WHERE label = 1) AS n, count(*) FILTER (WHERE label = 1 AND out) AS k, count(*) FILTER (WHERE label = 0 AND out) AS caught FROM tried GROUP BY ALL),
best AS (SELECT * FROM counts WHERE caught > 0 AND k <= n * {RISK / (2 * len(RULES))!r} QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, step) = 1),
path AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, number) AS place FROM best),
ruled AS ({ruled}),
hit AS (SELECT doc_id, min(place) AS first FROM ruled JOIN path USING (stratum, rule) WHERE value > cutoff GROUP BY doc_id),
tested AS (SELECT p.stratum, p.place, count(s.doc_id) AS n, count(s.doc_id) FILTER (WHERE h.first <= p.place) AS k FROM path p
  JOIN seen s ON s.stratum = p.stratum AND NOT s.chooses AND s.label = 1 LEFT JOIN hit h ON h.doc_id = s.doc_id GROUP BY ALL),
sure AS (SELECT stratum, place, CASE WHEN n = 0 OR k >= n * {RISK} THEN false ELSE {tail} <= {DELTA} / (SELECT greatest(1, count(DISTINCT stratum)) FROM seen) END AS ok FROM tested),
chain AS (SELECT stratum, place, bool_and(ok) OVER (PARTITION BY stratum ORDER BY place) AS certified FROM sure),
failed AS (SELECT doc_id, string_agg(rule, ',' ORDER BY number) AS names FROM ruled JOIN path USING (stratum, rule) JOIN chain USING (stratum, place) WHERE certified AND value > cutoff GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND f.names IS NULL AS kept, coalesce(f.names, '') AS failed_rules FROM b LEFT JOIN failed f ON f.doc_id = b.doc_id
"""


ORACLE = _oracle()
