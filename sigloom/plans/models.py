"""Queries that fit models: envelopes, coverage of populations, discrimination by group, resampling, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import coverage as C
from ..operators import discrimination as D
from ..operators import fits as L
from ..operators import normality as N
from ..operators import resampling as R
from ..operators.detectors import sampled_traces
from .queries import SAMPLES, rounded, spread_suppliers, supplier_sample, table
from .registry import query


@query("envelope_fits")
def envelope_fits(spark, sf_dir):
    """One lobe or two in each supplier's trace; the second burst's height and delay follow the nation and the balance."""
    s = spread_suppliers(spark, sf_dir).select("s_suppkey", "s_nationkey", "s_acctbal").where(F.col("s_suppkey").isNotNull())
    key = F.col("s_suppkey")
    middle = 1000.0 + F.pmod(key * 37, F.lit(2000))
    second = lambda i: X.gaussian_at(i, 2e6, F.pmod("s_nationkey", F.lit(5)) / 5.0, 20000.0 + F.pmod(key, F.lit(30)) * 1000.0, F.lit(8e-5), middle + 400 + F.pmod(F.abs("s_acctbal"), F.lit(400.0)), F.lit(0.0))
    t = sampled_traces(s, "signal", SAMPLES, lambda i: supplier_sample(i) + second(i), wide=8)
    both = t.select("s_suppkey", "signal", (middle - 500).alias("start"), (middle + 1100).alias("end"))
    told = L.compared(L.envelope_fits(both, "s_suppkey", "signal", "start", "end"))
    fit = told.select("s_suppkey", "n_points", F.col("one.center_ms").alias("center_ms"), "bic1", "bic2", "resolvability", "log_height_ratio", "delay_ms", "resolved", "weight", "reason")
    return rounded(fit, "center_ms", "log_height_ratio", "delay_ms", "resolvability", "weight", "bic1", "bic2", digits=4)


PROFILE = ["balance", "orders", "price"]
#: Customers by segment: what they ordered and got (finished orders) against what they have open.
PROFILES = """f AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS balance, count(o_orderkey)::DOUBLE AS orders, coalesce(avg(o_totalprice), 0) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = '{0}' GROUP BY 1, 2, 3)"""


def profiles(spark, sf_dir: str, status: str, mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    """A row for each customer: segment, balance, and number and mean price of orders of one status."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), mean(F.col("o_totalprice")).alias("price"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("balance"), F.coalesce("orders", F.lit(0)).cast("double").alias("orders"), F.coalesce("price", F.lit(0.0)).alias("price"))


_SCALES = "s AS (SELECT greatest(quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25), 1e-6) AS sb, greatest(quantile_cont(orders, 0.75) - quantile_cont(orders, 0.25), 1) AS so, greatest(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 1e-6) AS sp FROM f)"
_GAP = "sqrt(((a.balance - b.balance) / sb) * ((a.balance - b.balance) / sb) + ((a.orders - b.orders) / so) * ((a.orders - b.orders) / so) + ((a.price - b.price) / sp) * ((a.price - b.price) / sp))"
_BASE = f"""WITH {PROFILES.format('F')}, {_SCALES}, q AS ({PROFILES.format('O')[6:-1]}),
    l AS (SELECT a.seg, a.c_custkey, min({_GAP}) AS d FROM f a JOIN f b ON a.seg = b.seg AND a.c_custkey <> b.c_custkey, s GROUP BY 1, 2),
    t AS (SELECT seg AS class, quantile_cont(d, 0.95) AS threshold, count(*) AS n FROM l GROUP BY 1),
    p AS (SELECT a.c_custkey, b.seg AS class, b.c_custkey AS r, {_GAP} AS d FROM q a, f b, s),
    m AS (SELECT c_custkey, class, arg_min(r, (d, r)) AS nearest, min(d) AS distance FROM p GROUP BY 1, 2),
    c AS (SELECT m.*, threshold, distance <= threshold AS covered FROM m JOIN t USING (class))"""


def _steady_profiles(spark, sf_dir: str, status: str) -> DataFrame:
    """Equal orders give equal means to the bit, so that ties between customers do not go by rounding."""
    return profiles(spark, sf_dir, status, X.steady_mean)


def _covered(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    past, now = _steady_profiles(spark, sf_dir, "F"), _steady_profiles(spark, sf_dir, "O")
    scales = {k: v[1] for k, v in C.robust_scales(past, PROFILE, counts=("orders",)).items()}
    limits = C.thresholds(past, "c_custkey", PROFILE, scales, "seg")
    return C.coverage(C.nearest(now, past, "c_custkey", PROFILE, scales, "seg"), limits, "c_custkey"), limits


@query("class_thresholds", f"{_BASE} SELECT class, n::BIGINT AS n, round(threshold, 6) AS threshold FROM t")
def class_thresholds(spark, sf_dir):
    past = _steady_profiles(spark, sf_dir, "F")
    scales = {k: v[1] for k, v in C.robust_scales(past, PROFILE, counts=("orders",)).items()}
    return rounded(C.thresholds(past, "c_custkey", PROFILE, scales, "seg"), "threshold")


@query("class_nearest", f"{_BASE} SELECT c_custkey, class, nearest, round(distance, 6) AS distance, covered FROM c")
def class_nearest(spark, sf_dir):
    return rounded(_covered(spark, sf_dir)[0].select("c_custkey", "class", "nearest", "distance", "covered"), "distance")


@query(
    "class_coverage",
    f"""{_BASE}, k AS (SELECT DISTINCT class FROM t), n AS (SELECT count(DISTINCT c_custkey) AS n FROM c),
        w AS (SELECT c_custkey, count(*) FILTER (covered) AS k FROM c GROUP BY 1),
        o AS (SELECT class AS kind, avg(covered::INT) AS rate FROM c GROUP BY 1 UNION ALL
              SELECT a.class || '&' || b.class, avg((a.covered AND b.covered)::INT) FROM c a JOIN c b ON a.c_custkey = b.c_custkey AND a.class < b.class GROUP BY a.class, b.class UNION ALL
              SELECT 'any', avg((k > 0)::INT) FROM w UNION ALL SELECT 'none', avg((k = 0)::INT) FROM w UNION ALL SELECT 'all', avg((k = (SELECT count(*) FROM k))::INT) FROM w)
        SELECT kind, n, round(rate, 6) AS rate FROM o, n""",
)
def class_coverage(spark, sf_dir):
    return rounded(C.coverage_rates(_covered(spark, sf_dir)[0], "c_custkey"), "rate")


@query(
    "telling_cases",
    f"""{_BASE}, h AS (SELECT class, quantile_cont(distance, 0.5) AS m FROM c WHERE covered GROUP BY 1), r AS (
        SELECT class, 'inside' AS role, arg_min(c_custkey, (round(abs(distance - m), 9), c_custkey)) AS c_custkey FROM c JOIN h USING (class) WHERE covered GROUP BY 1 UNION ALL
        SELECT class, 'boundary', arg_min(c_custkey, (-distance, c_custkey)) FROM c WHERE covered GROUP BY 1 UNION ALL
        SELECT class, 'outside', arg_min(c_custkey, (distance, c_custkey)) FROM c WHERE NOT covered GROUP BY 1)
        SELECT r.class, role, r.c_custkey, nearest, round(distance, 6) AS distance FROM r JOIN c ON r.class = c.class AND r.c_custkey = c.c_custkey""",
)
def telling_cases(spark, sf_dir):
    return rounded(C.telling_cases(_covered(spark, sf_dir)[0], "c_custkey"), "distance")


@query("bootstrap_means")
def bootstrap_means(spark, sf_dir):
    """Mean price of a line by return flag; suppliers, and within them orders, are drawn with replacement."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(R.bootstrap_means(li, ["l_returnflag"], [["l_suppkey"], ["l_orderkey"]], "l_extendedprice", replicates=100), "estimate", "low", "high")


@query("bootstrap_spearman")
def bootstrap_spearman(spark, sf_dir):
    """Rank correlations of customers' profiles by segment, nations drawn with replacement and customers within them."""
    c = profiles(spark, sf_dir, "F").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    told = R.bootstrap_spearman(c, ["seg"], [["c_nationkey"], ["c_custkey"]], PROFILE, replicates=100)
    return rounded(told, "rho", "low", "high", "partial", "partial_low", "partial_high")


_FOLDS = """c AS (SELECT l_suppkey AS k, l_returnflag AS l, count(*) AS c FROM lineitem GROUP BY 1, 2), g AS (SELECT k, sum(c) AS n, arg_min(l, (-c, l)) AS lead FROM c GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY n DESC, k) - 1 AS i, dense_rank() OVER (ORDER BY lead) - 1 AS first FROM g)"""


@query("discrimination_folds", f"WITH {_FOLDS} SELECT k AS l_suppkey, ((CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END + first) % 5)::INT AS fold FROM o")
def discrimination_folds(spark, sf_dir):
    return D.group_folds(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("grouped_discrimination")
def grouped_discrimination(spark, sf_dir):
    """How well a line's return flag is told from its figures, each alone and together, on suppliers that were not learned from."""
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double"))
    features = ["l_quantity", "l_extendedprice", "day"]
    sets = {c: [c] for c in features} | {"all_three": features}
    told = D.held_out_predictions(li, "l_suppkey", "l_returnflag", features, sets)
    return rounded(D.contract_scores(told, "l_suppkey", replicates=100), "estimate", "low", "high")


@query(
    "normality",
    """WITH m AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS a FROM events GROUP BY 1),
       c AS (SELECT e.event_type, any_value(n) AS n, avg(power(value - a, 2)) AS m2, avg(power(value - a, 3)) AS m3, avg(power(value - a, 4)) AS m4 FROM events e JOIN m USING (event_type) GROUP BY 1),
       s AS (SELECT *, m3 / power(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
             (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
             6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM c),
       w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
       z AS (SELECT event_type, n, ln(y * sqrt((w2 - 1) / 2) + sqrt(y * y * (w2 - 1) / 2 + 1)) / sqrt(0.5 * ln(w2)) AS z1,
             (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * power((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1 / 3.0)) / sqrt(2 / (9 * a)) AS z2 FROM w)
       SELECT event_type, n::BIGINT AS n, 'dagostino' AS test, round(z1 * z1 + z2 * z2, 4) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p FROM z""",
)
def normality(spark, sf_dir):
    """Values by type; ``most`` is zero here, so that all sizes go by moments, which SQL has. Order statistics: ``group_comparison``."""
    return rounded(N.normality(table(spark, sf_dir, "events"), ["event_type"], "value", most=0).withColumn("statistic", F.round("statistic", 4)), "p")


@query("group_comparison")
def group_comparison(spark, sf_dir):
    """Customers' balances by segment: the overall test that their normality allows, and each two segments."""
    overall, pairs = N.compare_groups(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    one = overall.select("test", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "statistic", "p", F.lit(None).cast("double").alias("p_bonferroni"), F.lit(None).cast("double").alias("delta"))
    told = one.union(pairs.select(F.lit("mann_whitney").alias("test"), "a", "b", F.col("u").alias("statistic"), "p", "p_bonferroni", "delta"))
    return rounded(told, "statistic", "p", "p_bonferroni", "delta")
