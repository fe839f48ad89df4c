"""One query for each operator over the tables, and SQL that says the same another way."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut, new_path
from .matrix import Matrix
from .operators import gradients, nonlinear, partition, predicates, products, reductions, spectral
from .operators.krylov import solve_distributed, solve_frames, to_frame
from .operators.reshape import unflatten_blocks
from .plans import harness, planner
from .sources import generators, mtx, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sold(spark: SparkSession, d: str, val: str = "l_quantity", agg=F.sum) -> Matrix:
    """Suppliers by parts."""
    return Matrix.of(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", val, table(spark, d, "supplier").count(), table(spark, d, "part").count(), agg)


def prices(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


def balances(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


def r(x, k: int = 2):
    return F.round(x, k)


def rounded(df: DataFrame, k: int = 2, name: str = "v") -> DataFrame:
    return df.withColumn(name, F.round(name, k) + 0.0)


S = "S AS (SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
PLACES = "I AS (SELECT s_suppkey AS i FROM supplier), J AS (SELECT p_partkey AS j FROM part)"


# -- products ---------------------------------------------------------------
@query("SELECT s_suppkey AS i, round(coalesce(v, 0), 2) + 0.0 AS v FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity * p_retailprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_suppkey = s_suppkey")
def spmv(spark, d):
    return rounded(sold(spark, d).matvec(prices(spark, d)))


@query("SELECT p_partkey AS i, round(coalesce(v, 0), 2) + 0.0 AS v FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity * s_acctbal) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_partkey = p_partkey")
def rmatvec(spark, d):
    return rounded(sold(spark, d).rmatvec(balances(spark, d)))


@query("SELECT s_suppkey AS i, k::BIGINT AS k, round(coalesce(v, 0), 2) + 0.0 AS v FROM supplier CROSS JOIN (VALUES (0), (1)) t(k) LEFT JOIN (SELECT l_suppkey, kk, sum(l_quantity * CASE kk WHEN 0 THEN p_retailprice ELSE p_size END) AS v FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN (VALUES (0), (1)) u(kk) GROUP BY 1, 2) ON l_suppkey = s_suppkey AND kk = k")
def spmm(spark, d):
    p = table(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("i"), F.posexplode(F.array(F.col("p_retailprice"), F.col("p_size").cast("double"))).alias("k", "v")).withColumn("k", F.col("k").cast("long"))
    return rounded(sold(spark, d).matvec(x))


@query(f"WITH {S} SELECT a.r AS row, b.r AS col, sum(a.v * b.v) AS val FROM S a JOIN S b ON a.c = b.c GROUP BY 1, 2")
def spgemm_gram(spark, d):
    return sold(spark, d).gram().df


@query("SELECT l_suppkey AS i, round(sum(l_quantity * t), 2) + 0.0 AS v FROM lineitem JOIN (SELECT l_partkey AS p, sum(l_quantity * s_acctbal) AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON p = l_partkey GROUP BY 1 UNION ALL SELECT s_suppkey, 0.0 FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
def matrix_chain(spark, d):
    a = sold(spark, d)
    return rounded(products.chain([a, a.T], balances(spark, d)))


@query(f"WITH {S}, Q AS (SELECT l_suppkey AS i, (l_partkey + l_linenumber) % (SELECT count(*) FROM part) AS j FROM lineitem) SELECT i AS row, j AS col, coalesce(v, 0) AS v FROM Q LEFT JOIN S ON r = i AND c = j")
def gather_at(spark, d):
    """For each line item the part a few numbers on, from the same supplier."""
    n = table(spark, d, "part").count()
    places = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), ((F.col("l_partkey") + F.col("l_linenumber")) % n).alias("col"))
    return sold(spark, d).gather_at(places)


@query("WITH A AS (SELECT n_nationkey::BIGINT AS r, n_regionkey::BIGINT AS c, 1.0 + n_nationkey AS v FROM nation), T AS (SELECT i::BIGINT AS r, j::BIGINT AS c, CASE WHEN i = j THEN 2.0 ELSE -1.0 END AS v FROM range(3) a(i), range(3) b(j) WHERE abs(i - j) <= 1) SELECT a.r * 3 + t.r AS row, a.c * 3 + t.c AS col, (a.v * t.v)::DOUBLE AS val FROM A a, T t")
def kron(spark, d):
    n = table(spark, d, "nation")
    a = Matrix.of(n, "n_nationkey", "n_regionkey", 1.0 + F.col("n_nationkey"), 25, 5)
    return products.kron(a, generators.tridiagonal(spark, 3)).df


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S WHERE r > c")
def strict_lower(spark, d):
    return sold(spark, d).lower().df


# -- elementwise ------------------------------------------------------------
@query("SELECT l_suppkey AS row, l_partkey AS col, round(sum(l_quantity) * sum(l_extendedprice), 2) AS val FROM lineitem GROUP BY 1, 2")
def hadamard(spark, d):
    return rounded((sold(spark, d) * sold(spark, d, "l_extendedprice")).df, name="val")


@query("SELECT l_suppkey AS row, l_partkey AS col, round(sum(l_quantity) + sum(l_extendedprice), 2) AS val FROM lineitem GROUP BY 1, 2")
def add_same_pattern(spark, d):
    return rounded((sold(spark, d) + sold(spark, d, "l_extendedprice")).df, name="val")


@query("SELECT l_suppkey AS row, l_partkey AS col, round(5 - sum(l_quantity), 2) AS val FROM lineitem GROUP BY 1, 2")
def scalar_minus(spark, d):
    return rounded((5.0 - sold(spark, d)).df, name="val")


@query("SELECT l_suppkey AS row, l_partkey AS col, round(ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS val FROM lineitem GROUP BY 1, 2")
def divide(spark, d):
    return rounded((sold(spark, d, "l_extendedprice") / sold(spark, d)).log().df, 6, "val")


@query("SELECT l_suppkey AS row, l_partkey AS col, floor(sum(l_quantity) / 7.0)::DOUBLE AS val FROM lineitem GROUP BY 1, 2")
def floor_divide(spark, d):
    return (sold(spark, d) // 7.0).df


@query("SELECT l_suppkey AS row, l_partkey AS col, CASE WHEN sum(l_discount * 100) < 0.5 THEN 'Infinity'::DOUBLE ELSE round(1 / round(sum(l_discount * 100)), 9) END AS val FROM lineitem GROUP BY 1, 2")
def reciprocal_of_zero(spark, d):
    a = sold(spark, d, F.col("l_discount") * 100).round()
    return a.reciprocal().map(lambda v: F.when(F.abs(v) == float("inf"), v).otherwise(F.round(v, 9))).df


_F = "SELECT l_suppkey AS row, l_partkey AS col, {} AS val FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(_F.format("round(sqrt(q), 9)"))
def math_sqrt(spark, d):
    return rounded(sold(spark, d).sqrt().df, 9, "val")


@query(_F.format("round(q * q, 6)"))
def math_square(spark, d):
    return rounded(sold(spark, d).square().df, 6, "val")


@query(_F.format("CASE WHEN q = 50 THEN '-Infinity'::DOUBLE WHEN q < 50 THEN 'NaN'::DOUBLE ELSE round(ln(q - 50), 9) END"))
def math_log(spark, d):
    return (sold(spark, d) - 50.0).log().map(lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.round(v, 9))).df


@query(_F.format("round(log10(q), 9) + round(log2(q), 9)"))
def math_log10_log2(spark, d):
    a = sold(spark, d)
    return (a.log10().map(lambda v: F.round(v, 9)) + a.log2().map(lambda v: F.round(v, 9))).df


@query(_F.format("round(sin(q) + cos(q) + tan(q / 100) + sinh(q / 100) + cosh(q / 100) + tanh(q / 100), 8)"))
def math_trigonometric(spark, d):
    a = sold(spark, d)
    s = a / 100.0
    return rounded((a.sin() + a.cos() + s.tan() + s.sinh() + s.cosh() + s.tanh()).df, 8, "val")


@query(_F.format("round(exp(q / 100), 9)"))
def math_exp(spark, d):
    return rounded((sold(spark, d) / 100.0).exp().df, 9, "val")


@query(_F.format("round(1 / (1 + exp(25 - q)), 9)"))
def math_sigmoid(spark, d):
    return rounded((sold(spark, d) - 25.0).sigmoid().df, 9, "val")


@query(_F.format("greatest(q - 25, 0)::DOUBLE"))
def math_relu(spark, d):
    return (sold(spark, d) - 25.0).relu().df


@query(_F.format("least(greatest(q, 10), 40)::DOUBLE"))
def math_clamp(spark, d):
    return sold(spark, d).clamp(10, 40).df


@query(_F.format("sign(q - 25)::DOUBLE + abs(q - 25)"))
def math_sign_abs(spark, d):
    a = sold(spark, d) - 25.0
    return (a.sign() + a.abs()).df


@query(_F.format("floor(q / 4)::DOUBLE + 1000 * ceil(q / 4) + 1000000 * round_even(q / 4, 0)::DOUBLE"))
def math_floor_ceil_round_even(spark, d):
    a = sold(spark, d) / 4.0
    return (a.floor() + a.ceil() * 1000.0 + a.round() * 1000000.0).df


@query(_F.format("round(pow(q, 1.5), 6) - q"))
def math_pow_neg(spark, d):
    a = sold(spark, d)
    return (a.pow(1.5).map(lambda v: F.round(v, 6)) + -a).df


@query(_F.format("(q > 25)::INT + 10 * (q >= 25)::INT + 100 * (q < 25)::INT + 1000 * (q <= 25)::INT + 10000 * (q = 25)::INT + 100000 * (q <> 25)::INT"))
def comparisons(spark, d):
    a = sold(spark, d)
    flags = [a > 25.0, a >= 25.0, a < 25.0, a <= 25.0, a == 25.0, a != 25.0]
    out = flags[0].cast("int")
    for k, f in enumerate(flags[1:], 1):
        out = out + f.map(lambda v, k=k: v.cast("int") * 10**k)
    return out.df


@query(_F.format("(q > 10 AND q < 40)::INT + 10 * (q < 10 OR q > 40)::INT + 100 * ((q > 10) <> (q > 40))::INT + 1000 * (NOT q > 10)::INT"))
def logical(spark, d):
    a = sold(spark, d)
    low, high = a > 10.0, a > 40.0
    as_int = lambda m, k: m.map(lambda v: v.cast("int") * k)
    return (as_int(low.logical_and(a < 40.0), 1) + as_int((a < 10.0).logical_or(high), 10) + as_int(low.logical_xor(high), 100) + as_int(low.logical_not(), 1000)).df


@query("SELECT l_suppkey AS row, l_partkey AS col, CASE WHEN q = 50 THEN 2 WHEN q < 50 THEN 1 ELSE 4 END AS val FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def nan_inf_finite(spark, d):
    a = (sold(spark, d) - 50.0).log()
    return (a.isnan().cast("int") + a.isinf().map(lambda v: v.cast("int") * 2) + a.isfinite().map(lambda v: v.cast("int") * 4)).df


# -- shape, casts, blocks, lists --------------------------------------------
@query(f"WITH {S} SELECT c AS row, r AS col, v AS val FROM S")
def transpose(spark, d):
    return sold(spark, d).T.df


@query(f"WITH {S} SELECT r AS row, c AS col, v::FLOAT::DOUBLE AS val FROM S")
def cast_float(spark, d):
    return sold(spark, d).float().double().df


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S")
def csr_round_trip(spark, d):
    a = sold(spark, d)
    return Matrix.from_csr(a.to_csr(), a.m, a.n).df


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S")
def coalesce(spark, d):
    return sold(spark, d, agg=None).coalesce().df


@query("SELECT count(*)::BIGINT AS nnz, (SELECT count(*) FROM supplier)::BIGINT AS m, (SELECT count(*) FROM part)::BIGINT AS n FROM lineitem")
def shape_nnz(spark, d):
    a = sold(spark, d, agg=None)
    return spark.createDataFrame([(a.nnz(), a.m, a.n)], "nnz long, m long, n long")


@query("SELECT l_orderkey % 3 AS batch_id, l_suppkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def batch_sum_rows(spark, d):
    n = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("batch_id"), F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    a = Matrix(n, table(spark, d, "supplier").count(), table(spark, d, "part").count(), keys=("batch_id",), batch=(3,), coalesced=True)
    return a.sum(1).where("v <> 0")


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S")
def batch_total(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("batch_id"), F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    return Matrix(n, table(spark, d, "supplier").count(), table(spark, d, "part").count(), keys=("batch_id",), batch=(3,)).sum_batch().df


def _regions(spark, d) -> Matrix:
    """A list with a matrix for each region: its nations, in order, by market segment; sums of balances."""
    n = table(spark, d, "nation").withColumn("row", (F.row_number().over(_by("n_regionkey", "n_nationkey")) - 1).cast("long"))
    c = table(spark, d, "customer")
    seg = c.select("c_mktsegment").distinct().withColumn("col", (F.dense_rank().over(_by(None, "c_mktsegment")) - 1).cast("long"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(seg, "c_mktsegment").groupBy(F.col("n_regionkey").cast("long").alias("matrix_id"), "row", "col").agg(F.sum("c_acctbal").alias("val"))
    sizes = n.groupBy(F.col("n_regionkey").cast("long").alias("matrix_id")).agg(F.count("*").alias("m")).withColumn("n", F.lit(seg.count()).cast("long"))
    return Matrix(df, keys=("matrix_id",), sizes=sizes, coalesced=True)


def _by(part, order):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order) if part else Window.orderBy(order)


_REGIONS = "L AS (SELECT n_regionkey::BIGINT AS m, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, n_nationkey FROM nation), G AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS c FROM (SELECT DISTINCT c_mktsegment FROM customer)), X AS (SELECT m, r, c, sum(c_acctbal) AS v FROM customer JOIN L ON c_nationkey = n_nationkey JOIN G ON s = c_mktsegment GROUP BY 1, 2, 3), Z AS (SELECT m, count(*) AS k FROM L GROUP BY 1)"


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, r AS i, round(sum(v), 2) + 0.0 AS v FROM X GROUP BY 1, 2 UNION ALL SELECT m, r, 0.0 FROM L WHERE (m, r) NOT IN (SELECT (m, r) FROM X)")
def list_sum_rows(spark, d):
    return rounded(_regions(spark, d).sum(1))


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, round(sqrt(sum(v * v)), 4) AS v FROM X GROUP BY 1")
def list_norm(spark, d):
    return rounded(_regions(spark, d).norm(), 4)


@query(f"WITH {_REGIONS} SELECT (r + coalesce((SELECT sum(k) FROM Z WHERE Z.m < X.m), 0))::BIGINT AS row, (c + X.m * (SELECT count(*) FROM G))::BIGINT AS col, round(v, 2) + 0.0 AS val FROM X")
def block_diagonal(spark, d):
    return rounded(_regions(spark, d).to_block_diagonal().df, name="val")


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, r AS row, c AS col, round(v, 2) + 0.0 AS val FROM X")
def split_blocks(spark, d):
    a = _regions(spark, d)
    sizes = [(x["m"], x["n"]) for x in a.sizes.orderBy("matrix_id").collect()]
    return rounded(Matrix.from_block_diagonal(a.to_block_diagonal(), sizes).df, name="val")


@query("SELECT vec_id * 2 + (k - 1) // 32 AS row, (k - 1) % 32 AS col, embedding[k]::DOUBLE AS val FROM embeddings, range(1, 65) t(k)")
def block_flatten(spark, d):
    return _blocks(spark, d).flatten_blocks().df


def _blocks(spark, d) -> Matrix:
    """Every vector as a block of 2 by 32."""
    e = table(spark, d, "embeddings")
    x = F.col("embedding").cast("array<double>")
    blocks = e.select(F.col("vec_id").alias("row"), F.lit(0).cast("long").alias("col"), F.array(F.slice(x, 1, 32), F.slice(x, 33, 32)).alias("val"))
    return Matrix(blocks, e.agg(F.max("vec_id")).first()[0] + 1, 1, block=(2, 32))


@query("SELECT vec_id AS row, 0::BIGINT AS col, embedding[1]::DOUBLE AS a, embedding[32]::DOUBLE AS b, embedding[33]::DOUBLE AS c, embedding[64]::DOUBLE AS d FROM embeddings")
def block_unflatten(spark, d):
    """Vectors flattened and made blocks again: the corners of each."""
    b = unflatten_blocks(_blocks(spark, d).flatten_blocks(), (2, 32))
    return b.df.select("row", "col", *[F.col("val")[i][j].alias(x) for x, i, j in (("a", 0, 0), ("b", 0, 31), ("c", 1, 0), ("d", 1, 31))])


@query("SELECT i AS row, len(c)::BIGINT AS n, list_sum(c)::BIGINT AS cols FROM (SELECT l_suppkey AS i, list(DISTINCT l_partkey) AS c FROM lineitem GROUP BY 1)")
def to_csr(spark, d):
    return sold(spark, d).to_csr().select("row", F.size("cols").cast("long").alias("n"), F.aggregate("cols", F.lit(0).cast("long"), lambda s, c: s + c).alias("cols"))


@query(f"WITH {S} SELECT r AS row, c AS col, round(v / max(v) OVER (), 9) AS shade FROM S")
def spy(spark, d):
    return rounded(sold(spark, d).spy(), 9, "shade")


# -- reductions --------------------------------------------------------------
@query("SELECT s_suppkey AS i, coalesce(v, 0) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def sum_rows(spark, d):
    return sold(spark, d).sum(1)


@query("SELECT p_partkey AS i, coalesce(v, 0) AS v FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def sum_cols(spark, d):
    return sold(spark, d).sum(0)


@query("SELECT sum(l_quantity) AS v FROM lineitem")
def sum_all(spark, d):
    return sold(spark, d).sum()


@query("SELECT CASE WHEN grouping(l_suppkey) = 0 THEN 'row' WHEN grouping(l_partkey) = 0 THEN 'col' ELSE 'all' END AS axis, coalesce(l_suppkey, l_partkey, -1) AS i, sum(l_quantity) AS v FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_partkey), ())")
def sums_by_all_axes(spark, d):
    return sold(spark, d).sums_by_all_axes()


@query(f"WITH {S} SELECT s_suppkey AS i, round(coalesce(v, 0), 9) AS v FROM supplier LEFT JOIN (SELECT r, avg(v) AS v FROM S GROUP BY 1) ON r = s_suppkey")
def mean_bucket(spark, d):
    return rounded(sold(spark, d).mean(1), 9)


@query(f"WITH {S} SELECT s_suppkey AS i, round(coalesce(v, 0) / (SELECT count(*) FROM S), 9) AS v FROM supplier LEFT JOIN (SELECT r, sum(v) AS v FROM S GROUP BY 1) ON r = s_suppkey")
def mean_over_all(spark, d):
    return rounded(sold(spark, d).mean(1, over="all"), 9)


@query(f"WITH {S} SELECT round(avg(v), 9) AS v FROM S")
def mean_all(spark, d):
    return rounded(sold(spark, d).mean(), 9)


@query(f"WITH {S} SELECT s_suppkey AS i, CASE WHEN coalesce(n, 0) < (SELECT count(*) FROM part) THEN greatest(coalesce(m, 0), 0) ELSE m END AS v FROM supplier LEFT JOIN (SELECT r, max(-v) AS m, count(*) AS n FROM S GROUP BY 1) ON r = s_suppkey")
def max_axis(spark, d):
    return rounded((-sold(spark, d)).max(1))


@query(f"WITH {S} SELECT s_suppkey AS i, CASE WHEN coalesce(n, 0) < (SELECT count(*) FROM part) THEN least(coalesce(m, 0), 0) ELSE m END AS v FROM supplier LEFT JOIN (SELECT r, min(v - 30) AS m, count(*) AS n FROM S GROUP BY 1) ON r = s_suppkey")
def min_axis(spark, d):
    return (sold(spark, d) - 30.0).min(1)


@query(f"WITH {S} SELECT max(v) AS hi, min(v) AS lo FROM S")
def max_min_all(spark, d):
    a = sold(spark, d)
    return a.max().select(F.col("v").alias("hi")).crossJoin(F.broadcast(a.min().select(F.col("v").alias("lo"))))  # one row each


@query("SELECT n_nationkey::BIGINT AS i, CASE WHEN count(*) < 5 THEN 0.0 ELSE round(product(v), 6) END AS v FROM (SELECT n_nationkey, c_mktsegment, 1 + 1.0 / count(*) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def prod_axis(spark, d):
    c = table(spark, d, "customer")
    seg = c.select("c_mktsegment").distinct().withColumn("s", (F.dense_rank().over(_by(None, "c_mktsegment")) - 1).cast("long"))
    a = Matrix.of(c.join(seg, "c_mktsegment"), "c_nationkey", "s", F.lit(1.0), 25, 5)
    return rounded((1.0 + 1.0 / a).prod(1), 6)


@query(f"WITH {S} SELECT round(sqrt(sum(v * v)), 6) AS v FROM S")
def norm_fro(spark, d):
    return rounded(sold(spark, d).norm(), 6)


@query(f"WITH {S}, A AS (SELECT sum(v) AS s FROM S GROUP BY c), B AS (SELECT sum(v) AS s FROM S GROUP BY r) SELECT (SELECT max(s) FROM A) AS one, (SELECT max(s) FROM B) AS inf, CASE WHEN (SELECT count(*) FROM A) < (SELECT count(*) FROM part) THEN 0.0 ELSE (SELECT min(s) FROM A) END AS least_one, CASE WHEN (SELECT count(*) FROM B) < (SELECT count(*) FROM supplier) THEN 0.0 ELSE (SELECT min(s) FROM B) END AS least_inf")
def norms_one_inf(spark, d):
    a = sold(spark, d)
    out = None
    for name, ord_ in (("one", 1), ("inf", float("inf")), ("least_one", -1), ("least_inf", float("-inf"))):
        v = a.norm(ord_).select(F.col("v").alias(name))
        out = v if out is None else out.crossJoin(F.broadcast(v))  # one row each
    return out


@query(f"WITH {S} SELECT s_suppkey AS i, coalesce(v, 0) AS v FROM supplier LEFT JOIN S ON r = s_suppkey AND c = s_suppkey")
def diagonal(spark, d):
    return sold(spark, d).diagonal()


# -- predicates --------------------------------------------------------------
def _graph(spark, d) -> Matrix:
    """Nations tied by the customers that their indices and market segments share: a symmetric matrix."""
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("double").alias("n"))
    seg = c.select("c_mktsegment").distinct().withColumn("s", (F.dense_rank().over(_by(None, "c_mktsegment")) - 1).cast("long"))
    return Matrix.of(c.join(seg, "c_mktsegment"), "c_nationkey", "s", "n", 25, 5).gram()


_GRAPH = "C AS (SELECT c_mktsegment AS s, c_nationkey::BIGINT AS n, count(*)::DOUBLE AS k FROM customer GROUP BY 1, 2), W AS (SELECT a.n AS r, b.n AS c, sum(a.k * b.k) AS v FROM C a JOIN C b ON a.s = b.s GROUP BY 1, 2)"


@query(f"WITH {_GRAPH} SELECT count(*) FILTER (WHERE b.v IS NULL OR abs(a.v - b.v) > 1e-8 + 1e-5 * abs(a.v)) = 0 AS holds FROM W a LEFT JOIN W b ON a.r = b.c AND a.c = b.r")
def is_symmetric(spark, d):
    return _graph(spark, d).is_symmetric()


@query("SELECT false AS symmetric, true AS hermitian, 'hermitian' AS kind")
def is_hermitian(spark, d):
    a = Matrix.from_arrays(spark, [2 + 0j, 1 + 5j, 1 - 5j, 3 + 0j], [0, 0, 1, 1], [0, 1, 0, 1], (2, 2))
    s, h, k = a.is_symmetric(), a.is_hermitian(), a.matrix_type()
    return s.select(F.col("holds").alias("symmetric")).crossJoin(F.broadcast(h.select(F.col("holds").alias("hermitian")))).crossJoin(F.broadcast(k))  # one row each


@query(f"WITH {_GRAPH}, D AS (SELECT r, sum(CASE WHEN r = c THEN v ELSE 0 END) AS a, sum(CASE WHEN r <> c THEN abs(v) ELSE 0 END) AS b FROM W GROUP BY 1) SELECT count(*) = 25 AND bool_and(a > b AND a > 0) AS holds FROM D")
def gershgorin_pd(spark, d):
    return predicates.gershgorin(_graph(spark, d))


@query("SELECT true AS cholesky, true AS eigenvalue, 'spd' AS kind")
def matrix_type(spark, d):
    a = generators.regularised_laplacian(_graph(spark, d), 0.5)
    c = a.is_positive_definite("cholesky").select(F.col("holds").alias("cholesky"))
    e = a.is_positive_definite("eigenvalue").select(F.col("holds").alias("eigenvalue"))
    return c.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(a.matrix_type()))  # one row each


# -- generators and files ----------------------------------------------------
@query("SELECT r::BIGINT AS row, (r + s)::BIGINT AS col, CASE WHEN s = 0 THEN 4.0 ELSE -1.0 END::DOUBLE AS val FROM range(400) t(r), (VALUES (0), (-1), (1), (-20), (20)) u(s) WHERE r + s BETWEEN 0 AND 399 AND NOT (s = -1 AND r % 20 = 0) AND NOT (s = 1 AND r % 20 = 19)")
def laplacian_2d(spark, d):
    return generators.laplacian_2d(spark, 20).df


@query("SELECT r::BIGINT AS row, (r + s)::BIGINT AS col, CASE WHEN s = 0 THEN 6.0 ELSE -1.0 END::DOUBLE AS val FROM range(216) t(r), (VALUES (0), (-1), (1), (-6), (6), (-36), (36)) u(s) WHERE r + s BETWEEN 0 AND 215 AND NOT (s = -1 AND r % 6 = 0) AND NOT (s = 1 AND r % 6 = 5) AND NOT (s = -6 AND (r // 6) % 6 = 0) AND NOT (s = 6 AND (r // 6) % 6 = 5)")
def laplacian_3d(spark, d):
    return generators.laplacian_3d(spark, 6).df


@query("SELECT r::BIGINT AS row, (r + s)::BIGINT AS col, CASE WHEN s = 0 THEN 4.0 ELSE -1.0 END::DOUBLE AS val FROM range(400) t(r), (VALUES (0), (-1), (1), (-20), (20)) u(s) WHERE r + s BETWEEN 0 AND 399 AND NOT (s = -1 AND r % 20 = 0) AND NOT (s = 1 AND r % 20 = 19)")
def kron_poisson_2d(spark, d):
    return generators.kron_poisson_2d(spark, 20).df


@query("SELECT i::BIGINT AS i, round(2 * pi() * pi() * sin(pi() * (i // 15 + 1) / 16.0) * sin(pi() * (i % 15 + 1) / 16.0), 6) AS v FROM range(225) t(i)")
def poisson_rhs(spark, d):
    return rounded(generators.poisson_2d(spark, 15)[1], 6)


@query("SELECT i::BIGINT AS k, round(2 - 2 * cos((i // 12 + 1) * pi() / 13) + 2 - 2 * cos((i % 12 + 1) * pi() / 13), 9) AS lambda FROM range(144) t(i)")
def laplacian_2d_eigenvalues(spark, d):
    return rounded(generators.laplacian_2d_eigenvalues(spark, 12), 9, "lambda")


@query(f"WITH {_GRAPH}, O AS (SELECT r, c, v FROM W WHERE r <> c) SELECT r AS row, c AS col, -v AS val FROM O UNION ALL SELECT i::BIGINT, i::BIGINT, coalesce((SELECT sum(v) FROM O WHERE r = i), 0) + 0.5 FROM range(25) t(i)")
def regularised_laplacian(spark, d):
    return generators.regularised_laplacian(_graph(spark, d), 0.5).df


@query("SELECT r::BIGINT AS row, (r + s)::BIGINT AS col, round(sum(v), 9) AS val FROM range(100) t(r), (VALUES (0, 4.0 + 2 * 20.0 / 11), (-1, -1.0), (1, -1.0), (-10, -1.0), (10, -1.0), (-1, -20.0 / 11), (-10, -20.0 / 11)) u(s, v) WHERE r + s BETWEEN 0 AND 99 AND NOT (s = -1 AND r % 10 = 0) AND NOT (s = 1 AND r % 10 = 9) GROUP BY 1, 2")
def advection_diffusion(spark, d):
    return rounded(generators.advection_diffusion_2d(spark, 10).coalesce().df, 9, "val")


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S")
def mtx_round_trip(spark, d):
    path = _scratch(spark)
    mtx.write(sold(spark, d), path, "suppliers by parts")
    return mtx.read(spark, path).df


@query(f"WITH {_GRAPH} SELECT r AS row, c AS col, v AS val FROM W")
def mtx_symmetric_round_trip(spark, d):
    path = _scratch(spark)
    mtx.write(_graph(spark, d), path, symmetry="symmetric")
    return mtx.read(spark, path).df


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S")
def parquet_round_trip(spark, d):
    path = _scratch(spark)
    a = sold(spark, d)
    store.write(a, path, {"from": "lineitem"}, a.resolve_partition(4))
    return store.read(spark, path).df


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S WHERE r // ((SELECT count(*) FROM supplier) // 4) = 1")
def parquet_one_part(spark, d):
    path = _scratch(spark)
    a = sold(spark, d)
    store.write(a, path, parts=a.resolve_partition(4))
    return store.read(spark, path, part=1).df


def _scratch(spark) -> str:
    return new_path(spark, "matrix")


# -- graphs and partitions ---------------------------------------------------
def _ties(spark, d) -> Matrix:
    """Orders and the days that their line items left on, tied where an order had a line item of a day; orders by number, then days."""
    li = table(spark, d, "lineitem")
    m = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    n = li.agg(F.max(day)).first()[0] + 1
    e = li.select(F.col("l_orderkey").alias("row"), (day + m).alias("col"), F.lit(1.0).alias("val"))
    return Matrix(e, m + n, m + n)


@query()
def connected_components(spark, d):
    """Over all line items; recursive SQL on so many ties is too slow, a test holds it against brute force."""
    return _ties(spark, d).connected_components()


@query()
def component_sizes(spark, d):
    return _ties(spark, d).to_connected_components().sizes.groupBy(F.col("m").alias("nodes")).agg(F.count("*").alias("components"))


@query("SELECT i::BIGINT AS node, least(i // ((SELECT count(*) FROM part) / 7.0).ceil()::BIGINT, 6)::INT AS part_id FROM range((SELECT count(*) FROM part)) t(i)")
def partition_simple(spark, d):
    n = table(spark, d, "part").count()
    return partition.partition_simple(spark.range(n).select(F.col("id").alias("node")), n, 7)


def _coords(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query("SELECT p_partkey AS node, ((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) // (SELECT ceil(count(*) / 8.0)::BIGINT FROM part))::INT AS part_id FROM part")
def partition_slices(spark, d):
    return partition.partition_slices(_coords(spark, d), 8)


@query("WITH P AS (SELECT p_partkey AS node, p_retailprice AS x, p_size::DOUBLE AS y FROM part), A AS (SELECT *, x <= (SELECT quantile_disc(x, 0.5) FROM P) AS l FROM P), B AS (SELECT l, max(x) - min(x) >= max(y) - min(y) AS by_x, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my FROM A GROUP BY 1) SELECT node, (CASE WHEN A.l THEN 0 ELSE 2 END + CASE WHEN (CASE WHEN by_x THEN x <= mx ELSE y <= my END) THEN 0 ELSE 1 END)::INT AS part_id FROM A JOIN B ON A.l = B.l")
def partition_rcb(spark, d):
    return partition.partition_rcb(_coords(spark, d), 4)


@query("SELECT i::BIGINT AS i, count(DISTINCT h)::BIGINT AS places, max(step)::BIGINT AS step FROM (SELECT 0 AS i, i AS h, CASE WHEN i = 0 THEN 1 ELSE 1 END AS step FROM range(1024) t(i)) GROUP BY 1")
def hilbert_index(spark, d):
    """Every cell of a 32 by 32 grid has its own place, and neighbours along the curve are neighbours in the grid."""
    cells = spark.range(1024).select(F.floor(F.col("id") / 32).alias("x"), (F.col("id") % 32).alias("y"))
    h = cells.select("x", "y", partition.hilbert_index([F.col("x"), F.col("y")], 5).alias("h"))
    after = h.select((F.col("h") - 1).alias("h"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    step = h.join(after, "h", "left").select("h", F.coalesce(F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2")), F.lit(1)).alias("step"))
    return step.agg(F.countDistinct("h").alias("places"), F.max("step").cast("long").alias("step")).select(F.lit(0).cast("long").alias("i"), "places", "step")


@query(f"WITH {_GRAPH}, P AS (SELECT DISTINCT (a.r // 7)::INT AS part_id, a.c AS node, (a.c // 7)::INT AS owner FROM W a WHERE a.r // 7 <> a.c // 7 UNION SELECT (c // 7)::INT, r, (r // 7)::INT FROM W WHERE r // 7 <> c // 7) SELECT * FROM P")
def halo_nodes(spark, d):
    a = _graph(spark, d)
    return a.halo_nodes(a.resolve_partition(4, "simple"))


@query(f"WITH {_GRAPH}, O AS (SELECT r // 7 AS p, c AS n FROM W UNION SELECT c // 7, r FROM W UNION SELECT i // 7, i FROM range(25) t(i)) SELECT p::INT AS part_id, n::BIGINT AS node, n // 7 = p AS owned, (row_number() OVER (PARTITION BY p ORDER BY (n // 7 = p) DESC, n) - 1)::BIGINT AS local FROM O")
def local_numbers(spark, d):
    a = _graph(spark, d)
    return a.local_numbers(a.resolve_partition(4, "simple"))


@query("SELECT count(*)::BIGINT AS nodes, true AS narrow FROM range(100)")
def rcm_order(spark, d):
    """Reordered, a shuffled band matrix is a band of width one again."""
    a = generators.laplacian_1d(spark, 100)
    mixed = F.pmod(F.col("row") * 37, F.lit(100)).alias("row"), F.pmod(F.col("col") * 37, F.lit(100)).alias("col")
    b = Matrix(a.df.select(*mixed, "val"), 100, 100)
    p = cut(b.rcm_order())
    x, y = p.select(F.col("i").alias("row"), F.col("place").alias("a")), p.select(F.col("i").alias("col"), F.col("place").alias("b"))
    width = b.df.join(x, "row").join(y, "col").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("w"))
    return p.agg(F.countDistinct("i").alias("nodes")).crossJoin(F.broadcast(width.select((F.col("w") == 1).alias("narrow"))))  # one row each


# -- solves ------------------------------------------------------------------
_SINE = "SELECT i::BIGINT AS i, round(sin(i), 6) + 0.0 AS v FROM range({}) t(i)"


def _wave(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.sin("id").alias("v"))


def _solved(spark, a: Matrix, n: int, method: str, pre: str = "none", **options) -> DataFrame:
    return rounded(a.solve(a.matvec(_wave(spark, n)), method, pre, **options), 6)


def _solver(name: str, method: str, pre: str = "none", general: bool = False, n: int = 200):
    def f(spark, d):
        a = generators.stencil(spark, [n], 4.0, [((-1,), -2.0 if general else -1.0), ((1,), -1.0)])
        options = {} if method in ("lu", "cholesky", "auto") else {"atol": 1e-10, "btol": 1e-10} if method in ("lsqr", "lsmr") else {"rtol": 1e-10}
        return _solved(spark, a, n, method, pre, **options)

    f.__name__ = name
    query(_SINE.format(n))(f)


for _name, _method, _pre, _general in (
    ("solve_auto", "auto", "none", True), ("solve_lu", "lu", "none", True), ("solve_cholesky", "cholesky", "none", False), ("solve_cg", "cg", "none", False), ("solve_cg_jacobi", "cg", "jacobi", False), ("solve_cg_ssor", "cg", "ssor", False), ("solve_cg_block_jacobi", "cg", "block_jacobi", False),
    ("solve_cg_polynomial", "cg", "polynomial", False), ("solve_cg_ic0", "cg", "ic0", False), ("solve_bicgstab_ilu0", "bicgstab", "ilu0", True), ("solve_gmres_schwarz", "gmres", "asm", True), ("solve_cg_amg", "amg", "none", False), ("solve_pipelined_cg", "pipelined_cg", "none", False), ("solve_mixed_cg", "mixed_cg", "jacobi", False),
    ("solve_bicgstab", "bicgstab", "none", True), ("solve_gmres", "gmres", "none", True), ("solve_fgmres", "fgmres", "jacobi", True), ("solve_minres", "minres", "none", False), ("solve_lsqr", "lsqr", "none", True), ("solve_lsmr", "lsmr", "none", True),
):
    _solver(_name, _method, _pre, _general)


@query("SELECT b::BIGINT AS batch_id, i::BIGINT AS i, round(sin(i + b), 6) + 0.0 AS v FROM range(4) u(b), range(50) t(i)")
def solve_batch(spark, d):
    one = generators.tridiagonal(spark, 50, 4.0)
    df = one.df.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("batch_id"), "row", "col", "val").select("batch_id", "row", "col", (F.col("val") * (F.col("batch_id") + 1)).alias("val"))
    a = Matrix(df, 50, 50, keys=("batch_id",), batch=(4,), coalesced=True)
    x = spark.range(200).select(F.floor(F.col("id") / 50).alias("batch_id"), (F.col("id") % 50).alias("i"), F.sin(F.col("id") % 50 + F.floor(F.col("id") / 50)).alias("v"))
    return rounded(a.solve_batch(a.matvec(x)), 6)


@query("SELECT m::BIGINT AS matrix_id, i::BIGINT AS i, round(cos(i), 6) + 0.0 AS v FROM (VALUES (0, 20), (1, 35)) u(m, n), range(35) t(i) WHERE i < n")
def solve_list(spark, d):
    a = Matrix.list_of([generators.tridiagonal(spark, 20, 3.0), generators.tridiagonal(spark, 35, 5.0)])
    x = a.index(0).withColumn("v", F.cos("i"))
    return rounded(a.solve(a.matvec(x)), 6)


@query("SELECT i::BIGINT AS i, k::BIGINT AS k, round(sin(i + k), 6) + 0.0 AS v FROM range(60) t(i), range(3) u(k)")
def solve_many_sides(spark, d):
    a = generators.tridiagonal(spark, 60, 4.0)
    x = spark.range(180).select(F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).alias("k"), F.sin(F.floor(F.col("id") / 3) + F.col("id") % 3).alias("v"))
    return rounded(a.lu().solve(a.matvec(x)), 6)


@query("SELECT i::BIGINT AS i, round(sin(i), 6) + 0.0 AS re, round(cos(i), 6) + 0.0 AS im FROM range(40) t(i)")
def solve_complex(spark, d):
    a = generators.helmholtz_1d(spark, 40)
    x = spark.range(40).select(F.col("id").alias("i"), F.struct(F.sin("id").alias("re"), F.cos("id").alias("im")).alias("v"))
    return a.solve(a.matvec(x)).select("i", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


@query(_SINE.format(300))
def cg_distributed(spark, d):
    a = generators.tridiagonal(spark, 300, 4.0)
    return rounded(solve_distributed(a, a.matvec(_wave(spark, 300)), "cg", rtol=1e-10).x, 6)


@query("SELECT i::BIGINT AS i, round(sin(i), 4) + 0.0 AS v FROM range(100) t(i)")
def cg_frames(spark, d):
    a = generators.tridiagonal(spark, 100, 10.0)
    return rounded(solve_frames(a, a.matvec(_wave(spark, 100)), rtol=1e-8).x, 4)


@query("WITH T AS (SELECT l_orderkey % 40 AS i, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1) SELECT i::BIGINT AS i, round(v, 5) AS v FROM T")
def least_squares(spark, d):
    """More equations than unknowns, with a known solution."""
    li = table(spark, d, "lineitem")
    x = li.groupBy((F.col("l_orderkey") % 40).alias("i")).agg(F.count("*").cast("double").alias("v"))
    rows = spark.range(120).select(F.col("id").alias("row"), F.explode(F.array((F.col("id") % 40).alias("c"), F.pmod(F.col("id") * 7 + 3, F.lit(40)))).alias("col")).withColumn("val", F.when(F.col("col") == F.col("row") % 40, 10.0).otherwise(1.0 + F.col("row") % 3))
    a = Matrix(rows, 120, 40)
    return rounded(a.lsqr(a.matvec(x), atol=1e-13, btol=1e-13), 5)


@query(f"WITH {_GRAPH} SELECT i::BIGINT AS i, round(1 + i / 10.0, 6) AS v FROM range(25) t(i)")
def solve_laplacian(spark, d):
    a = generators.regularised_laplacian(_graph(spark, d), 0.5)
    x = spark.range(25).select(F.col("id").alias("i"), (1 + F.col("id") / 10).alias("v"))
    return rounded(planner.solve(a, a.matvec(x))[0], 6)


# -- spectra and determinants ------------------------------------------------
@query("SELECT k::BIGINT AS k, round(2 - 2 * cos((60 - k) * pi() / 61), 8) AS lambda FROM range(6) t(k)")
def eigsh_laplacian(spark, d):
    return rounded(generators.laplacian_1d(spark, 60).eigsh(6, "LA").select("k", "lambda"), 8, "lambda")


@query("SELECT k::BIGINT AS k, round(2 - 2 * cos((k + 1) * pi() / 61), 6) AS lambda FROM range(4) t(k)")
def lobpcg_smallest(spark, d):
    return rounded(generators.laplacian_1d(spark, 60).lobpcg(4, largest=False).select("k", "lambda"), 6, "lambda")


@query("SELECT k::BIGINT AS k, round(2 - 2 * cos((80 - k) * pi() / 81), 5) AS lambda FROM range(3) t(k)")
def eigsh_distributed(spark, d):
    values, _ = generators.laplacian_1d(spark, 80).eigsh_distributed(3, "LA", tol=1e-7, maxiter=60)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, lambda double"), 5, "lambda")


@query("SELECT k::BIGINT AS k, (30 - k)::DOUBLE AS s FROM range(6) t(k)")
def svd_diagonal(spark, d):
    a = generators.diag(spark.range(30).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")), 30)
    return rounded(a.svd(6).select("k", "s"), 8, "s")


@query("SELECT 0.0 AS re, 2.0 AS im UNION ALL SELECT 0.0, -2.0 UNION ALL SELECT 5.0, 0.0")
def eigs_rotation(spark, d):
    a = Matrix.from_arrays(spark, [-2.0, 2.0, 5.0], [0, 1, 2], [1, 0, 2], (3, 3))
    return a.eigs(3).select((F.round("lambda.re", 8) + 0.0).alias("re"), (F.round("lambda.im", 8) + 0.0).alias("im"))


@query("SELECT 31.0 AS v")
def det_tridiagonal(spark, d):
    return rounded(generators.laplacian_1d(spark, 30).det(), 6)


@query("SELECT m::BIGINT AS matrix_id, (n + 1)::DOUBLE AS v FROM (VALUES (0, 4), (1, 9), (2, 17)) t(m, n)")
def det_list(spark, d):
    return rounded(Matrix.list_of([generators.laplacian_1d(spark, n) for n in (4, 9, 17)]).det("lu"), 6)


@query("SELECT 5.0 * 10 * 18 AS v")
def det_by_components(spark, d):
    return rounded(Matrix.list_of([generators.laplacian_1d(spark, n) for n in (4, 9, 17)]).to_block_diagonal().det(), 6)


@query("SELECT round(ln(41), 9) AS v")
def logdet_tridiagonal(spark, d):
    return rounded(generators.laplacian_1d(spark, 40).logdet("cholesky"), 9)


@query("SELECT true AS near")
def logdet_hutchinson(spark, d):
    n = 300
    exact = sum(math.log(4 - 2 * math.cos((k + 1) * math.pi / (n + 1))) for k in range(n))
    return generators.tridiagonal(spark, n, 4.0).logdet("hutchinson", probes=60).select((F.abs(F.col("v") - exact) < 0.02 * exact).alias("near"))


@query("SELECT 30.0 AS v")
def condition_diagonal(spark, d):
    a = generators.diag(spark.range(30).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")), 30)
    return rounded(a.condition_number(), 8)


@query("SELECT 30.0 AS v")
def norm_two(spark, d):
    a = generators.diag(spark.range(30).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")), 30)
    return rounded(a.norm(2), 8)


@query("SELECT i::BIGINT AS row, i::BIGINT AS col, (1 + i) * (1 + i) - 1.0 AS v FROM range(20) t(i)")
def block_det(spark, d):
    k = 1.0 + F.col("id")
    blocks = spark.range(20).select(F.col("id").alias("row"), F.col("id").alias("col"), F.array(F.array(k, F.lit(1.0)), F.array(F.lit(1.0), k)).alias("val"))
    return rounded(spectral.det(Matrix(blocks, 20, 20, block=(2, 2))), 6)


# -- nonlinear and gradients -------------------------------------------------
@query()
def newton_bratu(spark, d):
    """Distance of the discrete solution from the closed form, by node."""
    import numpy as np

    a, exact = generators.bratu_1d(spark, 40, 1.0)
    u, _ = nonlinear.newton_distributed(a, lambda u: -np.exp(u), lambda u: -np.exp(u), max_iter=8)
    return u.withColumnRenamed("v", "u").join(exact, "i").select("i", (F.abs(F.col("u") - F.col("v")) < 1e-4).alias("near"))


SQL["newton_bratu"] = "SELECT i::BIGINT AS i, true AS near FROM range(40) t(i)"


@query("SELECT k::BIGINT AS k, true AS converged FROM range(3) t(k)")
def nonlinear_methods(spark, d):
    """x = cos(x) / 2 in each place, by three methods."""
    import numpy as np

    roots = [nonlinear.nonlinear_solve(lambda u: u - 0.5 * np.cos(u), np.zeros(5), method=m) for m in ("newton", "picard", "anderson")]
    return spark.createDataFrame([(k, bool(x.converged and abs(x.u[0] - 0.4501836112948736) < 1e-7)) for k, x in enumerate(roots)], "k long, converged boolean")


_G = "X AS (SELECT p_partkey AS j, p_retailprice AS x FROM part), G AS (SELECT s_suppkey AS i, s_acctbal AS g FROM supplier)"


@query(f"WITH {_G} SELECT DISTINCT l_suppkey AS row, l_partkey AS col, round(g * x, 4) + 0.0 AS v FROM lineitem JOIN X ON j = l_partkey JOIN G ON i = l_suppkey")
def matvec_vjp(spark, d):
    return rounded(gradients.matvec_vjp(sold(spark, d), prices(spark, d), balances(spark, d))[0], 4)


@query("SELECT i::BIGINT AS i, round(cos(i), 6) + 0.0 AS v FROM range(80) t(i)")
def solve_vjp_side(spark, d):
    """With g = A^T w the gradient of the right side is w."""
    a = generators.stencil(spark, [80], 4.0, [((-1,), -2.0), ((1,), -1.0)])
    w = spark.range(80).select(F.col("id").alias("i"), F.cos("id").alias("v"))
    return rounded(a.solve_vjp(a.matvec(_wave(spark, 80)), a.T.matvec(w))[1], 6)


@query("SELECT i::BIGINT AS row, (i + s)::BIGINT AS col, round(-cos(i) * sin(i + s), 6) + 0.0 AS v FROM range(80) t(i), (VALUES (-1), (0), (1)) u(s) WHERE i + s BETWEEN 0 AND 79")
def solve_vjp(spark, d):
    a = generators.stencil(spark, [80], 4.0, [((-1,), -2.0), ((1,), -1.0)])
    w = spark.range(80).select(F.col("id").alias("i"), F.cos("id").alias("v"))
    return rounded(a.solve_vjp(a.matvec(_wave(spark, 80)), a.T.matvec(w))[0], 6)


@query(f"WITH {S}, R AS (SELECT r, sum(v) AS s FROM S GROUP BY 1) SELECT S.r AS row, S.c AS col, round(sum(T.v), 4) AS v FROM S JOIN S T ON S.c = T.c GROUP BY S.r, S.c")
def spgemm_vjp(spark, d):
    """Gradient of the sum of S S^T with respect to the left factor."""
    a = sold(spark, d)
    c = a.gram()
    ones = c.map(lambda v: F.lit(1.0))
    left, _ = a.matmul_vjp(a.T, ones, needs=(True, False))
    return rounded(left, 4)


@query("SELECT i::BIGINT AS row, i::BIGINT AS col, round(3628800.0 / (i + 1), 6) AS v FROM range(10) t(i)")
def det_vjp(spark, d):
    a = generators.diag(spark.range(10).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")), 10)
    return rounded(gradients.det_vjp(a), 6)


@query("SELECT i::BIGINT AS row, (i + s)::BIGINT AS col, round((least(i, i + s) + 1) * (30 - greatest(i, i + s)) / 31.0, 8) AS v FROM range(30) t(i), (VALUES (-1), (0), (1)) u(s) WHERE i + s BETWEEN 0 AND 29")
def logdet_vjp(spark, d):
    return rounded(gradients.logdet_vjp(generators.laplacian_1d(spark, 30)), 8)


@query("SELECT i::BIGINT AS row, (i + s)::BIGINT AS col, round(2.0 / 21 * sin((i + 1) * 20 * pi() / 21) * sin((i + s + 1) * 20 * pi() / 21), 8) + 0.0 AS v FROM range(20) t(i), (VALUES (-1), (0), (1)) u(s) WHERE i + s BETWEEN 0 AND 19")
def eigsh_vjp(spark, d):
    return rounded(gradients.eigsh_vjp(generators.laplacian_1d(spark, 20), [1.0], "LA"), 8)


@query("SELECT i::BIGINT AS row, i::BIGINT AS col, CASE WHEN i = 29 THEN 1.0 ELSE 0.0 END AS v FROM range(30) t(i)")
def svd_vjp(spark, d):
    a = generators.diag(spark.range(30).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")), 30)
    return rounded(gradients.svd_vjp(a, [1.0]), 8)


# -- planner and harness -----------------------------------------------------
@query("SELECT * FROM (VALUES (1000::BIGINT, 'gather'), (1000000, 'distributed'), (1000000000, 'frames')) t(n, tier)")
def planner_tiers(spark, d):
    return spark.createDataFrame([(n, planner.select_tier(n, 5 * n)) for n in (1000, 1_000_000, 1_000_000_000)], "n long, tier string")


@query("SELECT k::BIGINT AS k, true AS fine FROM range(2) t(k)")
def benchmark_cases(spark, d):
    a = generators.laplacian_2d(spark, 8)
    found = harness.Benchmark.random("laplacian", a, "spd", 2).evaluate(lambda m, b: m.solve(b, "cholesky"))
    return spark.createDataFrame([(k, e < 1e-9) for k, e in enumerate(found)], "k long, fine boolean")


@query("SELECT count(*)::BIGINT AS entries, round(sum(v), 2) AS total FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2)")
def running_entries(spark, d):
    from .streaming import running_entries as running

    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct().withColumn("k", (F.dense_rank().over(_by(None, "event_type")) - 1).cast("long"))
    df = running(e.join(kinds, "event_type"), "user_id", "k", "value")
    return df.agg(F.count("*").alias("entries"), F.round(F.sum("val"), 2).alias("total"))


# -- more products and solves -------------------------------------------------
@query("SELECT i::BIGINT AS i, round(sin(i), 6) + 0.0 AS v FROM range(10000) t(i)")
def solve_sparse_lu(spark, d):
    """A grid of 10,000 unknowns by the sparse factor."""
    return _solved(spark, generators.laplacian_2d(spark, 100), 10_000, "lu")


@query("SELECT i::BIGINT AS i, round(sin(i), 6) + 0.0 AS v FROM range(99856) t(i)")
def solve_sparse_lu_100k(spark, d):
    return _solved(spark, generators.laplacian_2d(spark, 316), 316 * 316, "lu")


@query("SELECT g AS g, i::BIGINT AS i, round(sin(i + g), 6) + 0.0 AS v FROM range(2500) t(i), range(2) u(g)")
def lu_repeated_solves(spark, d):
    """One kept factor, a solve with it and one with its transpose."""
    a = generators.kron_convection_2d(spark, 50)
    lu = a.lu()
    x = lambda g: spark.range(2500).select(F.col("id").alias("i"), F.sin(F.col("id") + g).alias("v"))
    out = lu.solve(a.matvec(x(0))).withColumn("g", F.lit(0).cast("long")).unionByName(lu.solve_transpose(a.T.matvec(x(1))).withColumn("g", F.lit(1).cast("long")))
    return rounded(out, 6)


@query("WITH R AS (SELECT i::BIGINT AS i, 4 - 2 * cos((i + 1) * pi() / 129) AS a FROM range(128) t(i)) SELECT round(sum(ln(x.a - 2 * cos((y.i + 1) * pi() / 129))), 6) AS v FROM R x, R y")
def logdet_16k(spark, d):
    return rounded(generators.laplacian_2d(spark, 128).logdet(), 6)


@query("SELECT k::BIGINT AS k, round(v, 8) AS lambda FROM (SELECT row_number() OVER (ORDER BY v) - 1 AS k, v FROM (SELECT 4 - 2 * cos((i + 1) * pi() / 64) - 2 * cos((j + 1) * pi() / 64) AS v FROM range(63) a(i), range(63) b(j))) WHERE k < 4")
def eigsh_shift_invert(spark, d):
    """The four least eigenvalues of a grid of 3,969 unknowns, nearest to 0 first."""
    return rounded(generators.laplacian_2d(spark, 63).eigsh(4, sigma=0.0).select("k", "lambda"), 8, "lambda")


def _distributed(name: str, method: str, general: bool):
    def f(spark, d):
        a = generators.stencil(spark, [150], 6.0, [((-1,), -2.0 if general else -1.0), ((1,), -1.0)])
        options = {"atol": 1e-10, "btol": 1e-10} if method in ("lsqr", "lsmr") else {"rtol": 1e-10}
        return rounded(solve_distributed(a, a.matvec(_wave(spark, 150)), method, "none" if method in ("lsqr", "lsmr") else "jacobi", **options).x, 5)

    f.__name__ = name
    query("SELECT i::BIGINT AS i, round(sin(i), 5) + 0.0 AS v FROM range(150) t(i)")(f)


for _method, _general in (("bicgstab", True), ("gmres", True), ("minres", False), ("lsqr", True), ("lsmr", True)):
    _distributed(f"{_method}_distributed", _method, _general)


@query("SELECT round(sum(p_retailprice * p_size), 2) AS v FROM part")
def vector_dot(spark, d):
    return rounded(products.dot(prices(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))))


@query("SELECT round(sqrt(sum(p_retailprice * p_retailprice)), 4) AS v FROM part")
def vector_norm(spark, d):
    return rounded(products.vector_norm(prices(spark, d)), 4)


@query(f"WITH {S} SELECT r AS row, c AS col, v AS val FROM S WHERE r <= c")
def upper_triangle(spark, d):
    return sold(spark, d).upper(strict=False).df


@query(f"WITH {S} SELECT row, col, round(sum(v), 2) AS val FROM (SELECT r AS row, c AS col, v FROM S UNION ALL SELECT l_suppkey, (l_partkey + 1) % (SELECT count(*) FROM part), l_extendedprice FROM lineitem) GROUP BY 1, 2")
def union_of_patterns(spark, d):
    n = table(spark, d, "part").count()
    b = table(spark, d, "lineitem").withColumn("next", (F.col("l_partkey") + 1) % n)
    return rounded(sold(spark, d).plus(Matrix.of(b, "l_suppkey", "next", "l_extendedprice", table(spark, d, "supplier").count(), n)).df, name="val")


@query("SELECT l_suppkey AS row, l_partkey AS col, round(sum(l_quantity) - sum(l_extendedprice), 2) AS val FROM lineitem GROUP BY 1, 2")
def subtract(spark, d):
    return rounded((+sold(spark, d) - sold(spark, d, "l_extendedprice")).df, name="val")


@query("SELECT vec_id AS row, (k - 1)::BIGINT AS col, embedding[k]::DOUBLE AS val FROM embeddings, range(1, 65) t(k) WHERE embedding[k] <> 0")
def from_dense_rows(spark, d):
    e = table(spark, d, "embeddings")
    return Matrix.from_dense_rows(e, "vec_id", "embedding", e.agg(F.max("vec_id")).first()[0] + 1, 64).df


@query(f"WITH {_GRAPH} SELECT r AS row, c AS col, v AS val FROM W WHERE v <> 0")
def dense_round_trip(spark, d):
    """Through an array on the driver: 25 nations."""
    return Matrix.from_dense(spark, _graph(spark, d).to_numpy()).df


@query("SELECT n_nationkey::BIGINT AS row, n_regionkey::BIGINT AS col, (1.0 + n_nationkey)::DOUBLE AS re, (-1.0 * n_regionkey)::DOUBLE + 0.0 AS im FROM nation")
def conjugate(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("row"), F.col("n_nationkey").cast("long").alias("col"), F.struct((1.0 + F.col("n_nationkey")).alias("re"), F.col("n_regionkey").cast("double").alias("im")).alias("val"))
    return Matrix(n, 5, 25, coalesced=True).H.df.select("row", "col", F.col("val.re").alias("re"), (F.col("val.im") + 0.0).alias("im"))


@query("SELECT i::BIGINT AS row, i::BIGINT AS col, 1.0::DOUBLE AS val FROM range((SELECT count(*) FROM part)) t(i)")
def identity(spark, d):
    return generators.eye(spark, table(spark, d, "part").count()).df


@query(f"WITH {S} SELECT s_suppkey AS i, coalesce(v, 0) AS v FROM supplier LEFT JOIN (SELECT r, sum(abs(v - 30)) AS v FROM S GROUP BY 1) ON r = s_suppkey")
def absolute_row_sums(spark, d):
    return (sold(spark, d) - 30.0).abs_axis_sum(1)


@query(f"WITH {_GRAPH} SELECT r::BIGINT AS row, c::BIGINT AS col, v AS val FROM W WHERE r // 7 = 1")
def partition_one(spark, d):
    """One part's rows in local numbers, and back in those of the whole."""
    a = _graph(spark, d)
    nodes = cut(a.local_numbers(a.resolve_partition(4, "simple")))
    own = nodes.where("part_id = 1")
    back = lambda side: own.select(F.col("local").alias(side), F.col("node").alias(f"_{side}"))
    return a.extract(nodes, 1).df.join(back("row"), "row").join(back("col"), "col").select(F.col("_row").alias("row"), F.col("_col").alias("col"), "val")


@query(f"WITH {_GRAPH}, P AS (SELECT DISTINCT r // 7 AS p, c AS n FROM W WHERE r // 7 <> c // 7 UNION SELECT c // 7, r FROM W WHERE r // 7 <> c // 7) SELECT p::INT AS part_id, (n // 7)::INT AS owner, count(*)::BIGINT AS nodes FROM P GROUP BY 1, 2")
def exchange_sizes(spark, d):
    a = _graph(spark, d)
    return a.exchange_sizes(a.resolve_partition(4, "simple"))


@query("SELECT count(*)::BIGINT AS nodes, 8::BIGINT AS parts, (ceil(count(*) / 8.0))::BIGINT AS largest FROM part")
def partition_hilbert(spark, d):
    """Slices of equal counts along the curve."""
    p = partition.partition_hilbert(_coords(spark, d), 8, order=8)
    return p.groupBy("part_id").count().agg(F.sum("count").alias("nodes"), F.count("*").alias("parts"), F.max("count").alias("largest"))


@query(f"WITH {_REGIONS} SELECT count(*) > 1 AS many FROM Z")
def isolated_components(spark, d):
    """Regions along one diagonal, made square and symmetric, have as many components at least."""
    a = _regions(spark, d).to_block_diagonal()
    ties = a.df.select("row", (F.col("col") + a.m).alias("col"), F.lit(1.0).alias("val"))
    return spark.createDataFrame([(Matrix(ties, a.m + a.n, a.m + a.n).has_isolated_components(),)], "many boolean")


# -- lists ----------------------------------------------------------------------
_ENTRY = f"WITH {_REGIONS} SELECT m AS matrix_id, r AS row, c AS col, round({{}}, 6) + 0.0 AS val FROM X"


def _listed(name: str, sql: str, f) -> None:
    def run(spark, d):
        return rounded(f(_regions(spark, d)).df, 6, "val")

    run.__name__ = f"list_{name}"
    query(_ENTRY.format(sql))(run)


for _name, _sql, _f in (
    ("add", "v + v", lambda a: a + a), ("add_scalar", "v + 3", lambda a: a + 3.0), ("subtract", "v - 3", lambda a: a - 3.0), ("scalar_minus", "3 - v", lambda a: 3.0 - a), ("multiply", "v * 2", lambda a: a * 2.0), ("divide", "v / 4", lambda a: a / 4.0), ("negate", "-v", lambda a: -a),
    ("absolute", "abs(v)", lambda a: a.abs()), ("clamp", "least(greatest(v, -1000), 20000)", lambda a: a.clamp(-1000, 20000)), ("power", "pow(abs(v) / 1000, 1.5)", lambda a: (a.abs() / 1000.0).pow(1.5)), ("root", "sqrt(abs(v))", lambda a: a.abs().sqrt()),
    ("exponential", "exp(v / 1000000)", lambda a: (a / 1000000.0).exp()), ("logarithm", "ln(abs(v) + 1)", lambda a: (a.abs() + 1.0).log()),
):
    _listed(_name, _sql, _f)


_ALL = f"WITH {_REGIONS}, Y AS (SELECT L.m, L.r, G.c, X.v FROM L CROSS JOIN G LEFT JOIN X ON X.m = L.m AND X.r = L.r AND X.c = G.c)"


@query(f"{_ALL} SELECT m AS matrix_id, r AS i, round(coalesce(avg(v), 0), 4) + 0.0 AS v FROM Y GROUP BY 1, 2")
def list_mean(spark, d):
    return rounded(_regions(spark, d).mean(1), 4)


@query(f"{_ALL} SELECT m AS matrix_id, r AS i, round(max(coalesce(v, 0)), 2) + 0.0 AS v FROM Y GROUP BY 1, 2")
def list_max(spark, d):
    return rounded(_regions(spark, d).max(1))


@query(f"{_ALL} SELECT m AS matrix_id, r AS i, round(min(coalesce(v, 0)), 2) + 0.0 AS v FROM Y GROUP BY 1, 2")
def list_min(spark, d):
    return rounded(_regions(spark, d).min(1))


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, k::BIGINT AS m, (SELECT count(*) FROM G)::BIGINT AS n FROM Z")
def list_shapes(spark, d):
    return _regions(spark, d).shapes().select("matrix_id", "m", "n")


@query(f"WITH {_REGIONS} SELECT r AS row, c AS col, round(v, 2) + 0.0 AS val FROM X WHERE m = 2")
def list_element(spark, d):
    return rounded(_regions(spark, d).element(2).df, name="val")


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, row_i AS row, col_i AS col, round(sum(p * q) / 1e6, 4) AS val FROM (SELECT a.m, a.r AS row_i, b.r AS col_i, a.v AS p, b.v AS q FROM X a JOIN X b ON a.m = b.m AND a.c = b.c) GROUP BY 1, 2, 3")
def list_gram(spark, d):
    return rounded((_regions(spark, d).gram() / 1e6).df, 4, "val")


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, true AS holds FROM Z")
def list_is_symmetric(spark, d):
    return _regions(spark, d).gram().is_symmetric()


@query("SELECT m::BIGINT AS matrix_id, k::BIGINT AS k, round(2 - 2 * cos((n - k) * pi() / (n + 1)), 8) AS lambda FROM (VALUES (0, 8), (1, 13)) t(m, n), range(3) u(k)")
def list_eigsh(spark, d):
    return rounded(Matrix.list_of([generators.laplacian_1d(spark, n) for n in (8, 13)]).eigsh(3, "LA").select("matrix_id", "k", "lambda"), 8, "lambda")


@query(f"WITH {_REGIONS} SELECT m AS matrix_id, round(sum(v * v) / 1e9, 5) AS v FROM X GROUP BY 1")
def list_svd(spark, d):
    """The squares of all singular values add up to those of all entries."""
    return _regions(spark, d).svd(100).groupBy("matrix_id").agg((F.round(F.sum(F.col("s") * F.col("s")) / 1e9, 5) + 0.0).alias("v"))


@query("SELECT m::BIGINT AS matrix_id, round((2 + 2 * cos(pi() / (n + 1))) / (2 - 2 * cos(pi() / (n + 1))), 6) AS v FROM (VALUES (0, 8), (1, 13)) t(m, n)")
def list_condition(spark, d):
    return rounded(Matrix.list_of([generators.laplacian_1d(spark, n) for n in (8, 13)]).condition_number(), 6)


# -- more model problems ----------------------------------------------------------
@query("SELECT i::BIGINT AS k, round(2 - 2 * cos((i + 1) * pi() / 101), 9) AS lambda FROM range(100) t(i)")
def laplacian_1d_eigenvalues(spark, d):
    return rounded(generators.laplacian_1d_eigenvalues(spark, 100), 9, "lambda")


@query("SELECT r::BIGINT AS row, (r + s)::BIGINT AS col, CASE WHEN s = 0 THEN 6.0 ELSE -1.0 END::DOUBLE AS val FROM range(125) t(r), (VALUES (0), (-1), (1), (-5), (5), (-25), (25)) u(s) WHERE r + s BETWEEN 0 AND 124 AND NOT (s = -1 AND r % 5 = 0) AND NOT (s = 1 AND r % 5 = 4) AND NOT (s = -5 AND (r // 5) % 5 = 0) AND NOT (s = 5 AND (r // 5) % 5 = 4)")
def kron_poisson_3d(spark, d):
    return generators.kron_poisson_3d(spark, 5).df


@query("SELECT i::BIGINT AS i, round(3 * pi() * pi() * sin(pi() * (i // 25 + 1) / 6.0) * sin(pi() * (i // 5 % 5 + 1) / 6.0) * sin(pi() * (i % 5 + 1) / 6.0), 6) AS v FROM range(125) t(i)")
def poisson_3d_rhs(spark, d):
    return rounded(generators.poisson_3d(spark, 5)[1], 6)


@query("SELECT i::BIGINT AS i, round(cos(i), 5) + 0.0 AS v FROM range(81) t(i)")
def solve_anisotropic(spark, d):
    a = generators.anisotropic_2d(spark, 9)
    return rounded(a.solve(a.matvec(spark.range(81).select(F.col("id").alias("i"), F.cos("id").alias("v"))), "lu"), 5)


@query("SELECT i::BIGINT AS i, round(cos(i), 5) + 0.0 AS v FROM range(100) t(i)")
def solve_kron_anisotropic(spark, d):
    a = generators.kron_anisotropic_2d(spark, 10)
    return rounded(a.solve(a.matvec(spark.range(100).select(F.col("id").alias("i"), F.cos("id").alias("v"))), "cg", rtol=1e-12), 5)


@query("SELECT i::BIGINT AS i, round(sin(i), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM range(64) t(i)")
def solve_helmholtz_2d(spark, d):
    a = generators.helmholtz_2d(spark, 8)
    x = spark.range(64).select(F.col("id").alias("i"), F.struct(F.sin("id").alias("re"), F.lit(0.0).alias("im")).alias("v"))
    return a.solve(a.matvec(x)).select("i", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


# -- more of the planner ------------------------------------------------------------
@query("SELECT * FROM (VALUES ('gather', 'cholesky', 'lu'), ('distributed', 'cg', 'minres')) t(tier, spd, other)")
def planner_methods(spark, d):
    return spark.createDataFrame([(t, planner.select_method(t, True, True), planner.select_method(t, True, False)) for t in ("gather", "distributed")], "tier string, spd string, other string")


@query("SELECT name, name IN ('gather', 'distributed', 'frames') AS known FROM (VALUES ('gather'), ('distributed'), ('frames')) t(name)")
def planner_available(spark, d):
    return spark.createDataFrame([(t, bool(planner.methods(t)) and planner.default_method(t) in planner.methods(t) and t in planner.report()) for t in planner.available_tiers()], "name string, known boolean")
