"""Queries on dense arrays: each is an array of numbers for every vector, in millionths so that engines agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import arrays as A
from sparkloom.functions import matrices as M
from sparkloom.operators.ranking import sent
from sparkloom.plans.base import ORACLES, QUERIES, query, table
from sparkloom.plans.tabular import r6

_V = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_VM = f"WITH d AS ({_V}), m AS (SELECT vec_id, v, list_transform(range(8), lambda i: v[i * 8 + 1:i * 8 + 8]) AS m FROM d) "


def _v(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.withColumn("m", M.reshape(F.col("v"), 8))


def _register(name: str, f, sql: str) -> None:
    def run(spark, sf):
        value = F.transform(f(F.col("v"), F.col("m")), lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
        return _v(spark, sf).select("vec_id", F.array_join(value, ",").alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _VM + f"SELECT vec_id, array_to_string(list_transform({sql}, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS value FROM m"


def _each(f):
    return lambda v, m: F.transform(v, f)


def _at(v, i):
    return F.get(v, F.lit(i))


_T = "list_transform(range(1, 9), lambda j: list_transform(m, lambda r: r[j]))"
_DOT = "list_dot_product"
for _name, _f, _sql in (
    ("array_eye", lambda v, m: F.flatten(M.eye(8, 1)), "flatten(list_transform(range(8), lambda i: list_transform(range(8), lambda j: (j - i = 1)::INT)))"),
    ("array_full", lambda v, m: F.concat(F.array_repeat(F.lit(0.0), F.size(v)), F.array_repeat(F.lit(1.0), 3), F.transform(v, lambda x: F.lit(7.0))), "list_concat(list_transform(v, lambda x: 0.0), [1.0, 1.0, 1.0], list_transform(v, lambda x: 7.0))"),
    ("array_arange", lambda v, m: F.sequence(F.lit(3), F.lit(29), F.lit(4)), "range(3, 30, 4)"),
    ("array_linspace", lambda v, m: M.linspace(5, 50, 10), "list_transform(range(10), lambda i: 5 + i * 5.0::DOUBLE)"),
    ("array_logspace", lambda v, m: M.logspace(0, 1, 20), "list_transform(range(20), lambda i: pow(10, i * (1 / 20)))"),
    ("matrix_diagonal", lambda v, m: F.concat(M.diagonal(m), F.flatten(M.diagflat(F.slice(v, 1, 3)))), "list_concat(list_transform(range(8), lambda i: m[i + 1][i + 1]), [v[1], 0, 0, 0, v[2], 0, 0, 0, v[3]])"),
    ("matrix_tril", lambda v, m: F.flatten(M.tril(m, -1)), "flatten(list_transform(range(8), lambda i: list_transform(range(8), lambda j: CASE WHEN j < i THEN m[i + 1][j + 1] ELSE 0 END)))"),
    ("matrix_triu", lambda v, m: F.flatten(M.triu(m, 1)), "flatten(list_transform(range(8), lambda i: list_transform(range(8), lambda j: CASE WHEN j > i THEN m[i + 1][j + 1] ELSE 0 END)))"),
    ("matrix_reshape", lambda v, m: M.row_sums(M.reshape(v, 16)), "list_transform(range(4), lambda i: list_sum(v[i * 16 + 1:i * 16 + 16]))"),
    ("matrix_ravel_f", lambda v, m: M.ravel(m, "F"), "list_transform(range(64), lambda i: v[(i % 8) * 8 + i // 8 + 1])"),
    ("matrix_transpose", lambda v, m: M.row_sums(M.transpose(m)), f"list_transform({_T}, lambda r: list_sum(r))"),
    ("array_concatenate", lambda v, m: F.concat(v, F.reverse(v), F.array(F.lit(1.0))), "list_concat(v, list_reverse(v), [1.0])"),
    ("array_split", lambda v, m: F.array(*[A.total(F.slice(v, a + 1, b - a)) for a, b in ((0, 16), (16, 40), (40, 64))]), "[list_sum(v[1:16]), list_sum(v[17:40]), list_sum(v[41:64])]"),
    ("array_tile", lambda v, m: M.tile(F.slice(v, 1, 3), 3), "list_concat(v[1:3], v[1:3], v[1:3])"),
    ("array_repeat", lambda v, m: M.repeat(F.slice(v, 1, 3), 2), "[v[1], v[1], v[2], v[2], v[3], v[3]]"),
    ("array_trim_zeros", lambda v, m: A.trim_zeros(F.concat(F.array(F.lit(0.0)), v, F.array(F.lit(0.0), F.lit(0.0)))), "v"),
    ("array_unique_counts", lambda v, m: F.transform(F.array_sort(F.array_distinct(F.transform(v, F.signum))), lambda s: F.size(F.filter(v, lambda x: F.signum(x) == s))), "list_transform(list_sort(list_distinct(list_transform(v, lambda x: sign(x)))), lambda s: len(list_filter(v, lambda x: sign(x) = s)))"),
    ("matrix_fliplr", lambda v, m: F.flatten(M.fliplr(m)), "flatten(list_transform(m, lambda r: list_reverse(r)))"),
    ("matrix_flipud", lambda v, m: F.flatten(M.flipud(m)), "flatten(list_reverse(m))"),
    ("matrix_rot90", lambda v, m: F.flatten(M.rot90(m)), f"flatten(list_reverse({_T}))"),
    ("array_roll", lambda v, m: F.concat(A.roll(v, 5), A.roll(v, -2)), "list_concat(v[60:64], v[1:59], v[3:64], v[1:2])"),
    ("matrix_matmul", lambda v, m: F.flatten(M.matmul(m, M.transpose(m))), f"flatten(list_transform(m, lambda r: list_transform(m, lambda s: {_DOT}(r, s))))"),
    ("array_outer", lambda v, m: F.flatten(M.outer(F.slice(v, 1, 4), F.slice(v, 5, 4))), "flatten(list_transform(v[1:4], lambda x: list_transform(v[5:8], lambda y: x * y)))"),
    ("matrix_norm_trace", lambda v, m: F.array(F.sqrt(A.dot(v, v)), M.trace(m)), f"[sqrt({_DOT}(v, v)), list_sum(list_transform(range(8), lambda i: m[i + 1][i + 1]))]"),
    ("array_cross", lambda v, m: M.cross(F.slice(v, 1, 3), F.slice(v, 4, 3)), "[v[2] * v[6] - v[3] * v[5], v[3] * v[4] - v[1] * v[6], v[1] * v[5] - v[2] * v[4]]"),
    ("array_all_any", lambda v, m: F.array(F.forall(v, lambda x: x > -1).cast("int"), F.exists(v, lambda x: x > 0.2).cast("int")), "[(len(list_filter(v, lambda x: x > -1)) = 64)::INT, (len(list_filter(v, lambda x: x > 0.2)) > 0)::INT]"),
    ("array_finite", _each(lambda x: (F.isnan(F.try_divide(x, x)) | F.try_divide(x, x).isNull()).cast("int")), "list_transform(v, lambda x: (x = 0 OR isnan(x / x))::INT)"),
    ("array_logical", _each(lambda x: ((x > 0) & (x < 0.1)).cast("int") + 2 * ((x > 0) | (x < -0.1)).cast("int") + 4 * ((x > 0) != (x < 0.1)).cast("int")), "list_transform(v, lambda x: (x > 0 AND x < 0.1)::INT + 2 * (x > 0 OR x < -0.1)::INT + 4 * ((x > 0) <> (x < 0.1))::INT)"),
    ("array_is_close", _each(lambda x: A.is_close(x, F.round(x, 3), 1e-3, 1e-4).cast("int")), "list_transform(v, lambda x: (abs(x - round(x, 3)) <= 1e-4 + 1e-3 * abs(round(x, 3)))::INT)"),
    ("array_compare", lambda v, m: F.zip_with(v, F.reverse(v), lambda x, y: (x > y).cast("int") + 2 * (x >= y).cast("int") + 4 * (x == y).cast("int")), "list_transform(range(1, 65), lambda i: (v[i] > v[65 - i])::INT + 2 * (v[i] >= v[65 - i])::INT + 4 * (v[i] = v[65 - i])::INT)"),
    ("array_trigonometry", lambda v, m: F.concat(*[F.transform(v, f) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan)]), "list_concat(" + ", ".join(f"list_transform(v, lambda x: {f}(x))" for f in ("sin", "cos", "tan", "asin", "acos", "atan")) + ")"),
    ("array_hyperbolic", lambda v, m: F.concat(*[F.transform(v, f) for f in (F.sinh, F.cosh, F.tanh)]), "list_concat(" + ", ".join(f"list_transform(v, lambda x: {f}(x))" for f in ("sinh", "cosh", "tanh")) + ")"),
    ("array_degrees", lambda v, m: F.concat(F.transform(v, F.degrees), F.transform(v, F.radians)), "list_concat(list_transform(v, lambda x: degrees(x)), list_transform(v, lambda x: radians(x)))"),
    ("array_rounding", lambda v, m: F.concat(*[F.transform(v, f) for f in (lambda x: F.floor(x * 10), lambda x: F.ceil(x * 10), lambda x: F.rint(x * 10), lambda x: F.signum(x) * F.floor(F.abs(x * 10)))]), "list_concat(" + ", ".join(f"list_transform(v, lambda x: {f}(x * 10))" for f in ("floor", "ceil")) + ", list_transform(v, lambda x: round_even(x * 10, 0)), list_transform(v, lambda x: trunc(x * 10)))"),
    ("matrix_axis_sums", lambda v, m: F.concat(M.row_sums(m), M.row_sums(M.transpose(m)), F.transform(m, F.array_max), F.transform(m, F.array_min), F.transform(m, A.mean)), f"list_concat(list_transform(m, lambda r: list_sum(r)), list_transform({_T}, lambda r: list_sum(r)), list_transform(m, lambda r: list_max(r)), list_transform(m, lambda r: list_min(r)), list_transform(m, lambda r: list_avg(r)))"),
    ("array_cumulative", lambda v, m: F.concat(A.cumsum(v), A.cumprod(F.transform(F.slice(v, 1, 6), lambda x: x + 1))), "list_concat(list_transform(range(1, 65), lambda i: list_sum(v[1:i])), list_transform(range(1, 7), lambda i: list_product(list_transform(v[1:i], lambda x: x + 1))))"),
    ("array_diff", lambda v, m: F.concat(A.diff(v), A.diff(A.diff(v))), "list_concat(list_transform(range(1, 64), lambda i: v[i + 1] - v[i]), list_transform(range(1, 63), lambda i: v[i + 2] - 2 * v[i + 1] + v[i]))"),
    ("array_exponentials", lambda v, m: F.concat(*[F.transform(v, f) for f in (F.exp, F.expm1, lambda x: F.pow(F.lit(2.0), x), lambda x: F.log(F.abs(x) + 0.5), lambda x: F.log10(F.abs(x) + 0.5), lambda x: F.log2(F.abs(x) + 0.5), F.log1p)]), "list_concat(list_transform(v, lambda x: exp(x)), list_transform(v, lambda x: exp(x) - 1), list_transform(v, lambda x: pow(2, x)), list_transform(v, lambda x: ln(abs(x) + 0.5)), list_transform(v, lambda x: log10(abs(x) + 0.5)), list_transform(v, lambda x: log2(abs(x) + 0.5)), list_transform(v, lambda x: ln(1 + x)))"),
    ("array_signs", lambda v, m: F.concat(*[F.transform(v, f) for f in (lambda x: (x < 0).cast("int"), F.signum, F.abs, F.negate, lambda x: 3 * F.signum(x))]), "list_concat(list_transform(v, lambda x: (x < 0)::INT), list_transform(v, lambda x: sign(x)), list_transform(v, lambda x: abs(x)), list_transform(v, lambda x: -x), list_transform(v, lambda x: 3 * sign(x)))"),
    ("array_arithmetic", lambda v, m: F.zip_with(v, F.reverse(v), lambda x, y: (x + y) * (x - y) + F.try_divide(x, F.abs(y) + 1) + F.floor(x / (F.abs(y) + 1))), "list_transform(range(1, 65), lambda i: (v[i] + v[65 - i]) * (v[i] - v[65 - i]) + v[i] / (abs(v[65 - i]) + 1) + floor(v[i] / (abs(v[65 - i]) + 1)))"),
    ("array_powers", lambda v, m: F.concat(F.transform(v, lambda x: F.pow(x, F.lit(3.0))), F.transform(v, lambda x: x * x), F.transform(v, lambda x: F.sqrt(F.abs(x)))), "list_concat(list_transform(v, lambda x: pow(x, 3)), list_transform(v, lambda x: x * x), list_transform(v, lambda x: sqrt(abs(x))))"),
    ("array_remainders", lambda v, m: F.concat(F.transform(v, lambda x: A.modulo(x, F.lit(0.07))), F.transform(v, lambda x: x % 0.07)), "list_concat(list_transform(v, lambda x: x - 0.07::DOUBLE * floor(x / 0.07::DOUBLE)), list_transform(v, lambda x: x % 0.07::DOUBLE))"),
    ("array_clip", lambda v, m: A.clip(v, -0.05, 0.1), "list_transform(v, lambda x: least(greatest(x, -0.05), 0.1))"),
    ("array_sorting", lambda v, m: F.concat(F.array_sort(v), A.argsort(v)), "list_concat(list_sort(v), list_transform(list_grade_up(v), lambda i: i - 1))"),
    ("array_partition_kth", lambda v, m: F.array(*[F.element_at(F.array_sort(v), k) for k in (1, 10, 64)]), "[list_sort(v)[1], list_sort(v)[10], list_sort(v)[64]]"),
    ("array_nonzero", lambda v, m: F.concat(F.filter(F.transform(v, lambda x, i: F.when(x > 0.1, i)), lambda i: i.isNotNull()), F.array(F.size(F.filter(v, lambda x: x != 0)))), "list_concat(list_filter(list_transform(range(64), lambda i: CASE WHEN v[i + 1] > 0.1 THEN i END), lambda i: i IS NOT NULL), [len(list_filter(v, lambda x: x <> 0))])"),
    ("array_where", _each(lambda x: F.when(x > 0, x).otherwise(x * 10)), "list_transform(v, lambda x: CASE WHEN x > 0 THEN x ELSE x * 10 END)"),
    ("array_percentiles", lambda v, m: F.array(*[A.percentile(v, q) for q in (0.25, 0.5, 0.75)]), "[list_aggregate(v, 'quantile_cont', 0.25), list_aggregate(v, 'quantile_cont', 0.5), list_aggregate(v, 'quantile_cont', 0.75)]"),
    ("array_weighted_mean", lambda v, m: F.array(F.try_divide(A.dot(v, F.transform(v, lambda x, i: i + 1.0)), A.total(F.transform(v, lambda x, i: i + 1.0)))), f"[{_DOT}(v, list_transform(range(1, 65), lambda i: i::DOUBLE)) / 2080]"),
    ("array_covariance", lambda v, m: F.array(A.covariance(F.slice(v, 1, 32), F.slice(v, 33, 32)), A.correlation(F.slice(v, 1, 32), F.slice(v, 33, 32))), f"[({_DOT}(v[1:32], v[33:64]) - list_sum(v[1:32]) * list_sum(v[33:64]) / 32) / 31, ({_DOT}(v[1:32], v[33:64]) - list_sum(v[1:32]) * list_sum(v[33:64]) / 32) / 32 / sqrt(list_var_pop(v[1:32]) * list_var_pop(v[33:64]))]"),
    ("array_correlate", lambda v, m: F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: A.dot(F.slice(v, i + 1, 4), F.slice(v, 1, 4))), f"list_transform(range(61), lambda i: {_DOT}(v[i + 1:i + 4], v[1:4]))"),
    ("array_histogram", lambda v, m: A.bincount(F.transform(v, lambda x: A.histogram_bin(x, -0.2, 0.2, 8)), 8), "list_transform(range(8), lambda k: len(list_filter(v, lambda x: x >= -0.2 AND x <= 0.2 AND least(floor((x + 0.2::DOUBLE) * 8 / 0.4::DOUBLE), 7) = k)))"),
    ("array_digitize", _each(lambda x: A.searchsorted([-0.1, 0.0, 0.1], x, True)), "list_transform(v, lambda x: (x >= -0.1)::INT + (x >= 0)::INT + (x >= 0.1)::INT)"),
):
    _register(_name, _f, _sql)


@query("SELECT least(floor(l_quantity / 10), 4)::INT AS x, least(floor(l_discount / 0.02 + 1e-9), 4)::INT AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(spark, sf):
    x, y = F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)), F.least(F.floor(F.col("l_discount") / 0.02 + 1e-9), F.lit(4))
    return table(spark, sf, "lineitem").groupBy(x.cast("int").alias("x"), y.cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k::INT AS value, count(l_quantity) AS n FROM range(0, 52) t(k) LEFT JOIN lineitem ON l_quantity::INT = k GROUP BY k")
def bincount_dense(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(52).select(F.col("id").cast("int").alias("value")).join(sent(n), "value", "left").na.fill(0, ["n"])  # a row for each value


def _decomposition(name: str):
    def run(spark, sf):
        return _v(spark, sf).select("vec_id", F.transform(M.linalg(F.col("v"), name), r6).alias("x")).select("vec_id", F.array_join(F.col("x").cast("array<string>"), ",").alias("value"))

    run.__name__ = f"linalg_{name}"
    return run


for _name in M.LINALG:
    QUERIES[f"linalg_{_name}"] = _decomposition(_name)
