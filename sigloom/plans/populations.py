"""Queries that compare populations and choose rows and groups, beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import populations as P
from ..operators import selection as C
from .queries import event_spans, rounded, table
from .registry import query

TYPES = ["click", "error", "purchase", "signup", "view"]
_RANKS = "r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, value FROM events)"


@query(
    "kruskal",
    f"""WITH {_RANKS}, s AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY value)),
       a AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) AS k FROM s)
       SELECT n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, (k - 1)::INT AS df FROM a, t""",
)
def kruskal(spark, sf_dir):
    return rounded(P.kruskal(table(spark, sf_dir, "events"), "value", "event_type", TYPES), "h")


@query(
    "mann_whitney",
    """WITH p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT event_type AS g FROM events) a JOIN (SELECT DISTINCT event_type AS g FROM events) b ON a.g < b.g),
       v AS (SELECT p.a, p.b, e.value, count(*) FILTER (e.event_type = p.a) AS ca, count(*) FILTER (e.event_type = p.b) AS cb FROM p JOIN events e ON e.event_type IN (p.a, p.b) GROUP BY 1, 2, 3),
       c AS (SELECT *, coalesce(sum(cb) OVER (PARTITION BY a, b ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
       s AS (SELECT a, b, sum(ca)::DOUBLE AS m, sum(cb)::DOUBLE AS n, sum(ca * (below + cb / 2.0))::DOUBLE AS u, sum((ca + cb)::DOUBLE * (ca + cb) * (ca + cb) - (ca + cb)) AS t FROM c GROUP BY 1, 2)
       SELECT a, b, m::BIGINT AS n_a, n::BIGINT AS n_b, u, round(sign(u - m * n / 2) * greatest(abs(u - m * n / 2) - 0.5, 0) / sqrt(m * n / 12 * ((m + n + 1) - t / ((m + n) * (m + n - 1)))), 6) AS z FROM s""",
)
def mann_whitney(spark, sf_dir):
    return rounded(P.mann_whitney(table(spark, sf_dir, "events"), "value", "event_type", TYPES), "z")


@query(
    "anova",
    """WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g)
       SELECT round((sum(g.n * (m - mean) * (m - mean)) / (max(k) - 1)) / (sum(g.n * v) / (max(t.n) - max(k))), 6) AS f, (max(k) - 1)::BIGINT AS df_between, (max(t.n) - max(k))::BIGINT AS df_within FROM g, t""",
)
def anova(spark, sf_dir):
    return rounded(P.anova(table(spark, sf_dir, "events"), "value", "event_type"), "f")


@query(
    "distribution_distances",
    """WITH v AS (SELECT value, count(*) FILTER (event_type = 'click')::DOUBLE AS a, count(*) FILTER (event_type = 'view')::DOUBLE AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
       c AS (SELECT sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER () AS d, coalesce(lead(value) OVER (ORDER BY value) - value, 0) AS gap FROM v WINDOW w AS (ORDER BY value))
       SELECT round(max(abs(d)), 6) AS ks, round(sum(abs(d) * gap), 6) AS wasserstein, round(2 * sum(d * d * gap), 6) AS energy FROM c""",
)
def distribution_distances(spark, sf_dir):
    return rounded(P.distances(table(spark, sf_dir, "events"), "value", "event_type", "click", "view"), "ks", "wasserstein", "energy")


@query(
    "binned_median",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM lineitem),
       b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= l_extendedprice))::INT AS bin, l_extendedprice AS x, l_quantity AS y FROM lineitem, e)
       SELECT bin, count(*)::BIGINT AS n, round(quantile_cont(x, 0.5), 6) AS median_x, round(quantile_cont(y, 0.5), 6) AS median_y FROM b GROUP BY bin HAVING count(*) >= 3""",
)
def binned_median(spark, sf_dir):
    return rounded(P.binned_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), "median_x", "median_y")


@query(
    "support_grid",
    """WITH c AS (SELECT x.x::INT AS x_bin, y.y::INT AS y_bin FROM range(0, 5) x(x), range(0, 4) y(y)),
       b AS (SELECT floor(l_quantity / 12)::INT AS x_bin, least(floor(l_discount / 0.025)::INT, 3) AS y_bin, l_returnflag = 'R' AS s FROM (SELECT l_quantity, round(l_discount, 4) AS l_discount, l_returnflag FROM lineitem) WHERE l_quantity < 60),
       n AS (SELECT x_bin, y_bin, count(*) AS n, count_if(s) AS s FROM b GROUP BY 1, 2)
       SELECT c.x_bin, c.y_bin, coalesce(n, 0)::BIGINT AS n, coalesce(s, 0)::BIGINT AS supported, CASE WHEN n > 0 THEN round(s / n, 6) END AS rate FROM c LEFT JOIN n ON c.x_bin = n.x_bin AND c.y_bin = n.y_bin""",
)
def support_grid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.round("l_discount", 4))
    return rounded(P.support_grid(li, "l_quantity", "l_discount", F.col("l_returnflag") == "R", [0, 12, 24, 36, 48, 60], [0, 0.025, 0.05, 0.075, 0.1]), "rate")


@query(
    "threshold_sweep",
    """WITH t AS (SELECT unnest([5.0, 10.0, 20.0, 50.0, 1000.0])::DOUBLE AS threshold), p AS (SELECT count_if(event_type = 'error') AS p FROM events),
       c AS (SELECT threshold, count(value) AS n, count_if(event_type = 'error' AND value IS NOT NULL) AS h FROM t LEFT JOIN events ON value >= threshold GROUP BY 1)
       SELECT threshold, n::BIGINT AS accepted, CASE WHEN n > 0 THEN round(h / n, 6) END AS precision, round(h / p, 6) AS recall, CASE WHEN h > 0 THEN round(2 * h / (n + p), 6) ELSE 0 END AS f1 FROM c, p""",
)
def threshold_sweep(spark, sf_dir):
    return rounded(P.threshold_sweep(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error", [5.0, 10.0, 20.0, 50.0, 1000.0]), "precision", "recall", "f1")


@query(
    "membership_rates",
    """WITH f AS (SELECT l_returnflag, l_quantity > 25 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c FROM lineitem),
       k AS (SELECT l_returnflag, unnest(['large', 'cheap', 'taxed', 'large&cheap', 'large&taxed', 'cheap&taxed', 'any', 'none', 'all']) AS kind,
                    unnest([a, b, c, a AND b, a AND c, b AND c, a OR b OR c, NOT (a OR b OR c), a AND b AND c]) AS x FROM f)
       SELECT l_returnflag, kind, round(avg(x::INT), 6) AS rate FROM k GROUP BY 1, 2""",
)
def membership_rates(spark, sf_dir):
    sets = {"large": F.col("l_quantity") > 25, "cheap": F.col("l_discount") > 0.05, "taxed": F.col("l_tax") > 0.04}
    return rounded(P.membership_rates(table(spark, sf_dir, "lineitem"), ["l_returnflag"], sets), "rate")


@query(
    "tier_summary",
    """WITH a AS (SELECT o_orderpriority AS tier, count(*)::BIGINT AS n, count_if(o_totalprice > 150000)::BIGINT AS accepted, round(quantile_cont(CASE WHEN o_totalprice > 150000 THEN o_totalprice END, 0.5), 6) AS median_accepted,
              round(quantile_cont(CASE WHEN NOT o_totalprice > 150000 THEN o_totalprice END, 0.5), 6) AS median_other FROM orders GROUP BY 1),
       r AS (SELECT tier, string_agg(s || ':' || k, ',' ORDER BY s) AS reasons FROM (SELECT o_orderpriority AS tier, o_orderstatus AS s, count(*) AS k FROM orders GROUP BY 1, 2) GROUP BY 1)
       SELECT a.*, reasons FROM a JOIN r USING (tier)""",
)
def tier_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "tier")
    return rounded(P.tier_summary(o, "tier", F.col("o_totalprice") > 150000, "o_totalprice", "o_orderstatus"), "median_accepted", "median_other")


@query(
    "distribution_overlap",
    """WITH s AS (SELECT l_shipmode, b, n / sum(n) OVER (PARTITION BY l_shipmode) AS x FROM (SELECT l_returnflag AS l_shipmode, floor(l_quantity / 10)::INT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2))
       SELECT a.l_shipmode AS a, b.l_shipmode AS b, round(sum(least(a.x, b.x)), 6) AS overlap FROM s a JOIN s b ON a.b = b.b AND a.l_shipmode < b.l_shipmode GROUP BY 1, 2""",
)
def distribution_overlap(spark, sf_dir):
    return rounded(P.distribution_overlap(table(spark, sf_dir, "lineitem"), "l_returnflag", F.floor(F.col("l_quantity") / 10).cast("int")), "overlap")


@query(
    "slowdown",
    """WITH p AS (SELECT event_type, floor(value / 5)::DOUBLE AS x, count(*)::DOUBLE AS n FROM events WHERE value < 100 GROUP BY 1, 2), c AS (SELECT event_type, x, sum(n) OVER (PARTITION BY event_type ORDER BY x) AS y, count(*) OVER (PARTITION BY event_type) AS k FROM p),
       s AS (SELECT event_type, x, k, CASE WHEN k >= 5 THEN (coalesce(lag(y) OVER w, y) + y + coalesce(lead(y) OVER w, y)) / 3 ELSE y END AS s FROM c WINDOW w AS (PARTITION BY event_type ORDER BY x)),
       d AS (SELECT *, (s - lag(s) OVER w) / greatest(x - lag(x) OVER w, 1e-9) AS d FROM s WINDOW w AS (PARTITION BY event_type ORDER BY x)),
       t AS (SELECT *, max(d) OVER (PARTITION BY event_type) AS top, max(s) OVER (PARTITION BY event_type) AS best FROM d),
       a AS (SELECT *, min(CASE WHEN d = top THEN x END) OVER (PARTITION BY event_type) AS steep FROM t)
       SELECT event_type, CASE WHEN max(k) < 3 THEN NULL WHEN max(top) > 0 THEN coalesce(min(CASE WHEN x > steep AND d <= 0.2 * top THEN x END), min(CASE WHEN s >= 0.95 * best THEN x END), max(x)) ELSE min(x) END AS threshold FROM a GROUP BY 1""",
)
def slowdown(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value < 100").groupBy("event_type", F.floor(F.col("value") / 5).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return P.slowdown(e.withColumn("y", F.sum("n").over(Window.partitionBy("event_type").orderBy("x"))), ["event_type"], "x", "y")


@query(
    "scaled_distance",
    """SELECT c_mktsegment, round(avg(sqrt(0.75 * power((c_acctbal - 4500) / 2000, 2) + 0.25 * power((c_nationkey - 12) / 5, 2))), 6) AS mean_distance,
       count_if(sqrt(0.75 * power((c_acctbal - 4500) / 2000, 2) + 0.25 * power((c_nationkey - 12) / 5, 2)) <= 1)::BIGINT AS inside FROM customer GROUP BY 1""",
)
def scaled_distance(spark, sf_dir):
    d = P.scaled_distance({"c_acctbal": 4500.0, "c_nationkey": 12.0}, {"c_acctbal": 2000.0, "c_nationkey": 5.0}, {"c_acctbal": 3.0, "c_nationkey": 1.0})
    return rounded(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg(d).alias("mean_distance"), F.count_if(d <= 1).alias("inside")), "mean_distance")


# choosing rows and groups


@query(
    "selected_rows",
    """WITH x AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE text IS NULL OR n_chars < 50)
       SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND n_chars < 5000 AND doc_id NOT IN (SELECT doc_id FROM x WHERE doc_id IS NOT NULL)""",
)
def selected_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = C.exclusions([labels.where("toxic = 1"), docs.where("text is null or n_chars < 50")], "doc_id")
    return C.select_rows(docs, out, "doc_id", [F.col("lang").isin("en", "de"), F.col("n_chars") < 5000]).select("doc_id", "lang", "source")


@query(
    "population_differences",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1)
       SELECT k AS key, problem, FROM (SELECT k, CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'unknown' WHEN n > 1 OR m > 1 THEN 'repeated' END AS problem FROM a FULL JOIN b USING (k)) WHERE problem IS NOT NULL""",
)
def population_differences(spark, sf_dir):
    whole = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"))
    return C.population_differences(whole, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


@query(
    "best_of_equals",
    """SELECT l_suppkey, l_quantity, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1""",
)
def best_of_equals(spark, sf_dir):
    return C.keep_best(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_quantity"], "l_extendedprice", "l_orderkey").select("l_suppkey", "l_quantity", "l_orderkey", "l_extendedprice")


@query(
    "median_case",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1), r AS (SELECT event_type, median, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - median), event_id) AS r FROM events JOIN m USING (event_type))
       SELECT event_type, round(median, 6) AS median, event_id, value FROM r WHERE r = 1""",
)
def median_case(spark, sf_dir):
    return rounded(C.median_case(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id"), "median")


@query(
    "nearest_to_guard",
    """WITH d AS (SELECT event_type, event_id, least(s % 3600, 3600 - s % 3600) AS distance FROM (SELECT event_type, event_id, epoch_us(ts) // 1000000 AS s FROM events)),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY distance, event_id) AS r FROM d WHERE distance >= 120) SELECT event_type, event_id, distance::BIGINT AS distance FROM r WHERE r = 1""",
)
def nearest_to_guard(spark, sf_dir):
    e = event_spans(spark, sf_dir)
    return C.nearest_to_guard(e, ["event_type"], F.col("start"), 3600, 120, ["event_id"]).withColumn("distance", F.col("distance").cast("long"))


@query(
    "accepted_of_top",
    """SELECT user_id, count_if(event_type <> 'error')::BIGINT AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5 GROUP BY 1""",
)
def accepted_of_top(spark, sf_dir):
    return C.accepted_of_top(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 5, F.col("event_type") != "error")


@query(
    "balanced_groups",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY sha256('bg:source:' || c_custkey), c_custkey) AS s FROM customer),
       src AS (SELECT *, c_nationkey || '/' || c_mktsegment AS source FROM o WHERE s = 1), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('bg:' || c_custkey), c_custkey) AS r FROM src),
       n AS (SELECT *, floor((r - 1) / 2)::INT AS drawn FROM r) SELECT c_custkey, c_mktsegment, source, drawn FROM n WHERE drawn IN (SELECT drawn FROM n GROUP BY drawn HAVING count(*) = 10)""",
)
def balanced_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("source", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return C.balanced_groups(c, "c_mktsegment", "source", "c_custkey", "bg", 2, 5)


@query(
    "blocks_60_20_20",
    """WITH b AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('fu:' || c_nationkey), c_nationkey) AS r FROM b),
       q AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS q FROM r), s AS (SELECT c_mktsegment, c_nationkey, CASE WHEN n = 1 THEN 'train' WHEN r <= q THEN 'test' WHEN n > 2 AND r <= 2 * q THEN 'val' ELSE 'train' END AS split FROM q)
       SELECT c_mktsegment, split, count(*)::BIGINT AS n FROM customer JOIN s USING (c_mktsegment, c_nationkey) GROUP BY 1, 2""",
)
def blocks_60_20_20(spark, sf_dir):
    return C.blocks_60_20_20(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "fu").groupBy("c_mktsegment", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_partition",
    """WITH b AS (SELECT DISTINCT event_type, user_id FROM events), r AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY sha256('gp:' || user_id), user_id) AS r FROM b)
       SELECT event_type, user_id, CASE WHEN r <= least(greatest(round_even(n * 0.3, 0), 1), n - 1) THEN 'calibration' ELSE 'fit' END AS part FROM r""",
)
def group_partition(spark, sf_dir):
    return C.group_partition(table(spark, sf_dir, "events"), "event_type", "user_id", "gp", 0.3).select("event_type", "user_id", "part").distinct()


@query(
    "free_windows",
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + floor(value * 40)::BIGINT AS f FROM events), u AS (SELECT user_id, min(s) AS a, max(f) AS b FROM e GROUP BY 1),
       w AS (SELECT user_id, unnest(range(a, b - 3600 + 1, 1800)) AS s FROM u)
       SELECT user_id, s AS start, s + 3600 AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.s - 60 < w.s + 3600 AND e.f + 60 > w.s)""",
)
def free_windows(spark, sf_dir):
    e = event_spans(spark, sf_dir)
    spans = e.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return C.free_windows(spans, e, "user_id", 3600, 1800, 60)


@query(
    "listed_bounds",
    """WITH f AS (SELECT user_id, list(event_id) AS ids, count_if(value > 50) AS j, count(*) AS n FROM events WHERE event_id % 7 < 3 GROUP BY 1), l AS (SELECT user_id, j, n, unnest(ids) AS event_id FROM f),
       b AS (SELECT l.user_id, j, l.n, event_type, count(*) AS k FROM l JOIN events USING (event_id) GROUP BY 1, 2, 3, 4)
       SELECT event_type, sum(k)::BIGINT AS listed, sum(greatest(0, j - (n - k)))::BIGINT AS least_wrong, sum(least(j, k))::BIGINT AS most_wrong FROM b GROUP BY 1""",
)
def listed_bounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = e.where("event_id % 7 < 3").groupBy("user_id").agg(F.to_json(F.collect_list("event_id")).alias("ids"), F.count_if(F.col("value") > 50).alias("judged"))
    return C.listed_bounds(files, "ids", e, "event_id", "event_type", "judged")


_NEXT = "n AS (SELECT user_id, event_type, s, f, value, lead(s) OVER w AS s2, lead(f) OVER w AS f2, lead(value) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"
_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + floor(value * 40)::BIGINT AS f FROM events)"


@query(
    "merge_rule",
    f"""WITH {_E}, {_NEXT}, m AS (SELECT *, greatest(0, least(f, f2) - greatest(s, s2)) / nullif(greatest(f, f2) - least(s, s2), 0) AS iou, abs((s + f) / 2.0 - (s2 + f2) / 2.0) AS c, abs(value - v2) AS q FROM n WHERE s2 IS NOT NULL)
       SELECT rule, count(*)::BIGINT AS n FROM (SELECT CASE WHEN iou >= 0.8 THEN 'duplicate' WHEN iou >= 0.1 AND c <= 600 AND q <= 20 THEN 'same' WHEN iou >= 0.1 AND (c <= 600 OR q <= 20) AND q <= 40 THEN 'unsure' END AS rule FROM m) GROUP BY rule""",
)
def merge_rule(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    e = event_spans(spark, sf_dir).select("user_id", "start", "end", "value", F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("f2"), F.lead("value").over(w).alias("v2")).where("s2 is not null")
    gap = F.abs((F.col("start") + F.col("end")) / 2 - (F.col("s2") + F.col("f2")) / 2)
    value = F.abs(F.col("value") - F.col("v2"))
    iou = X.hull_iou(F.col("start"), F.col("end"), F.col("s2"), F.col("f2"))
    return e.groupBy(C.merge_rule(iou, gap, value, value, 0.8, 0.1, 600.0, 20.0, 40.0).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "boundary_decision",
    f"""WITH {_E}, b AS (SELECT user_id, s, f FROM e WHERE event_type = 'error'), c AS (SELECT user_id, event_id, (s + f) / 2.0 AS c, value > 20 AS ok FROM e WHERE event_type = 'click'),
       d AS (SELECT c.event_id, c.c, c.ok, min(least(abs(c.c - b.s), abs(c.c - b.f))) AS d, bool_or(b.s <= c.c AND c.c < b.f) AS inside FROM c LEFT JOIN b USING (user_id) GROUP BY 1, 2, 3)
       SELECT reason, count(*)::BIGINT AS n, count_if(NOT coalesce(inside, false) AND (NOT near OR ok))::BIGINT AS kept FROM
       (SELECT *, coalesce(d <= 900, false) OR coalesce(inside, false) AS near, CASE WHEN inside THEN 'inside' WHEN coalesce(d <= 900, false) AND NOT ok THEN 'no_clean_support' WHEN coalesce(d <= 900, false) THEN 'supported' ELSE 'clear' END AS reason FROM d) GROUP BY 1""",
)
def boundary_decision(spark, sf_dir):
    e = event_spans(spark, sf_dir)
    errors = e.where("event_type = 'error'").groupBy("user_id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    clicks = e.where("event_type = 'click'").join(errors, "user_id", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    told = C.boundary_decision((F.col("start") + F.col("end")) / 2, F.coalesce("gone", empty), 900.0, F.col("value") > 20)
    return clicks.select(told.alias("d")).groupBy("d.reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("d.kept").alias("kept"))
