"""The library's operators over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import detectors as D
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import sampling as S
from ..operators import stats as T
from ..operators import summaries as U
from .registry import query


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def micros(ts) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def event_spans(spark, sf_dir: str) -> DataFrame:
    """Each event as an interval of whole seconds, as long as 40 times its value."""
    start = F.floor(micros("ts") / 1000000).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start"), (start + F.floor(F.col("value") * 40).cast("long")).alias("end"), "value", "event_type")


SPANS = """spans AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + floor(value * 40)::BIGINT AS e, value, event_type FROM events)"""


# gates and reasons


@query(
    "gate_reasons",
    """SELECT CASE WHEN l_quantity < 5 THEN 'below_min' WHEN l_quantity > 45 THEN 'above_max' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'kept' END AS reason,
       count(*)::BIGINT AS n FROM lineitem GROUP BY 1""",
)
def gate_reasons(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return U.reasons(table(spark, sf_dir, "lineitem"), [("below_min", q < 5), ("above_max", q > 45), ("discounted", d > 0.08)]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_policy",
    """SELECT event_type, CASE WHEN value < 10 THEN 'unclear' ELSE event_type END AS label, CASE WHEN value < 10 THEN 'below_threshold' ELSE 'kept' END AS reason, count(*)::BIGINT AS n
       FROM events GROUP BY 1, 2, 3""",
)
def label_policy(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", X.label_or_unclear(F.col("event_type"), F.col("value"), 10.0, True))
    return e.groupBy("event_type", F.col("x.label").alias("label"), F.col("x.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_field",
    """SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""",
)
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(
    "frequency_bands",
    """WITH b AS (SELECT event_type, CASE WHEN value >= 0 AND value < 5 THEN 'low' WHEN value >= 5 AND value < 20 THEN 'mid' ELSE 'high' END AS band FROM events),
       c AS (SELECT event_type, band, count(*)::BIGINT AS n FROM b GROUP BY 1, 2)
       SELECT event_type, band, n, round(100.0 * n / sum(n) OVER (PARTITION BY event_type), 6) AS percent FROM c""",
)
def frequency_bands(spark, sf_dir):
    bands = [("low", 0.0, 5.0), ("mid", 5.0, 20.0), ("high", 20.0, float("inf"))]
    return rounded(U.histogram(table(spark, sf_dir, "events"), ["event_type"], X.band(F.col("value"), bands)), "percent")


# aggregations


@query(
    "percentile_summary",
    """SELECT o_orderpriority, count(o_totalprice)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, round(CASE WHEN count(o_totalprice) = 1 THEN 0.0 ELSE stddev_samp(o_totalprice) END, 4) AS std,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, max(o_totalprice) AS max
       FROM orders GROUP BY o_orderpriority""",
)
def percentile_summary(spark, sf_dir):
    return rounded(U.percentile_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"median": 0.5, "p90": 0.9, "p99": 0.99}), "mean", "std", "median", "p90", "p99", digits=4)


@query(
    "dense_thresholds",
    """WITH g AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('absent')) a(event_type), (VALUES (5.0::DOUBLE), (50.0), (200.0)) t(threshold))
       SELECT g.event_type, g.threshold, count(e.event_id)::BIGINT AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND e.value >= g.threshold GROUP BY 1, 2""",
)
def dense_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counts = U.threshold_counts(e, ["event_type"], "value", [5.0, 50.0, 200.0])
    declared = {"event_type": ["click", "view", "purchase", "signup", "error", "absent"], "threshold": [5.0, 50.0, 200.0]}
    return U.dense(e, counts, ["event_type", "threshold"], declared, ["n"])


@query(
    "reduction_pivot",
    """SELECT l_linestatus, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS raw, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS filtered,
       round(1 - sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS reduction FROM lineitem GROUP BY 1""",
)
def reduction_pivot(spark, sf_dir):
    out = U.reduction_pivot(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "A", "R", F.sum("l_quantity"))
    return rounded(rounded(out, "raw", "filtered", digits=4), "reduction")


@query(
    "grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean
       FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""",
)
def grouping_sets(spark, sf_dir):
    return rounded(U.grouping_sets(table(spark, sf_dir, "orders"), [[], ["o_orderstatus"], ["o_orderpriority"]], [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")]), "mean", digits=4)


@query(
    "against_baseline",
    """WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linestatus, mean AS baseline FROM m WHERE l_returnflag = 'N')
       SELECT m.l_linestatus, l_returnflag, round(mean, 4) AS mean, round(baseline, 4) AS baseline, round(mean - baseline, 4) AS delta, round(100 * (1 - mean / baseline), 6) AS reduction_percent
       FROM m JOIN b ON m.l_linestatus = b.l_linestatus""",
)
def against_baseline(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_extendedprice").alias("mean"))
    return rounded(rounded(U.against_baseline(m, "l_linestatus", "l_returnflag", "mean", "N"), "mean", "baseline", "delta", digits=4), "reduction_percent")


@query(
    "worst_users",
    """SELECT user_id, max(value) AS max, count(*) FILTER (value > 100)::BIGINT AS n_high FROM events GROUP BY user_id ORDER BY n_high DESC, max DESC, user_id LIMIT 20""",
)
def worst_users(spark, sf_dir):
    return U.worst(table(spark, sf_dir, "events"), "user_id", "value", 100.0, 20)


@query(
    "robust_z",
    """WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.user_id, median(abs(value - med)) AS mad FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1)
       SELECT event_id, round((value - med) / greatest(1.4826 * mad, 1e-12), 6) AS z FROM events e JOIN m ON e.user_id = m.user_id JOIN d ON e.user_id = d.user_id""",
)
def robust_z(spark, sf_dir):
    return rounded(U.robust_z(table(spark, sf_dir, "events"), ["user_id"], "value", 1.4826).select("event_id", "z"), "z")


@query(
    "iqr_scale",
    """SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS center, round(greatest(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 1e-6), 6) AS scale FROM part GROUP BY 1""",
)
def iqr_scale(spark, sf_dir):
    center, scale = U.iqr_scale("p_retailprice", 1e-6)
    return rounded(table(spark, sf_dir, "part").groupBy("p_brand").agg(center.alias("center"), scale.alias("scale")), "center", "scale")


@query(
    "duplicate_families",
    """SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS canonical, list_sort(list(DISTINCT doc_id))::VARCHAR AS members, count(DISTINCT source)::BIGINT AS sources
       FROM documents GROUP BY sha256(text) HAVING count(*) >= 2""",
)
def duplicate_families(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    out = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("canonical"), F.array_sort(F.collect_set("doc_id")).alias("m"), F.count_distinct("source").alias("sources")).where("n >= 2")
    return out.withColumn("members", F.concat(F.lit("["), F.array_join(F.col("m").cast("array<string>"), ", "), F.lit("]"))).drop("m")


@query(
    "leak_audit",
    """SELECT 'digest' AS key, sha256(text) AS value, count(DISTINCT source)::BIGINT AS owners, count(*)::BIGINT AS n FROM documents GROUP BY 2 HAVING count(DISTINCT source) > 1""",
)
def leak_audit(spark, sf_dir):
    return U.leaks(table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256)), "source", ["digest"])


@query(
    "effective_size",
    """SELECT event_type, round(sum(value) * sum(value) / sum(value * value), 6) AS ess FROM events GROUP BY 1""",
)
def effective_size(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(U.effective_size("value").alias("ess")), "ess")


@query(
    "percentile_rank",
    """SELECT p_partkey, round(100.0 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 0.5) / count(*) OVER (PARTITION BY p_brand), 6) AS percentile_rank FROM part""",
)
def percentile_rank(spark, sf_dir):
    return rounded(U.percentile_rank(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_partkey", "percentile_rank"), "percentile_rank")


@query(
    "noise_moments",
    """SELECT label, count(*)::BIGINT AS n, round(avg(m), 6) AS mean, round(avg(r), 6) AS rms FROM (SELECT label, list_avg(embedding::DOUBLE[]) AS m, sqrt(list_avg(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS r FROM embeddings) GROUP BY label""",
)
def noise_moments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    return rounded(e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(X.array_mean(F.col("a"))).alias("mean"), F.avg(X.array_rms(F.col("a"))).alias("rms")), "mean", "rms")


@query(
    "changes",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT l_orderkey, l_linenumber, l_quantity > 20 AS big FROM lineitem WHERE l_linenumber <> 3)
       SELECT CASE WHEN b.l_orderkey IS NULL THEN 'removed' WHEN a.l_orderkey IS NULL THEN 'new' WHEN a.big = b.big THEN 'retained' ELSE 'changed' END AS status, count(*)::BIGINT AS n
       FROM (SELECT l_orderkey, l_linenumber, bool_or(big) AS big FROM a GROUP BY 1, 2) a FULL JOIN (SELECT l_orderkey, l_linenumber, bool_or(big) AS big FROM b GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1""",
)
def changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda skip, q: li.where(F.col("l_linenumber") != skip).groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_quantity") > q).alias("big"))
    return U.changes(side(2, 25), side(3, 20), ["l_orderkey", "l_linenumber"], ["big"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# intervals


@query(
    "active_runs",
    """WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), a AS (SELECT * FROM o WHERE value >= 15),
       g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY event_id) <= 2 THEN 0 ELSE 1 END AS f FROM a))
       SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*)::BIGINT AS n FROM g GROUP BY user_id, g""",
)
def active_runs(spark, sf_dir):
    return I.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") >= 15, max_gap=1)


@query(
    "merged_intervals",
    f"""WITH {SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans WHERE s < e),
       g AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
       SELECT user_id, min(s) AS start, max(e) AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, g""",
)
def merged_intervals(spark, sf_dir):
    return I.merge(event_spans(spark, sf_dir), ["user_id"])


@query(
    "candidate_clusters",
    f"""WITH {SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans WHERE s < e),
       g AS (SELECT *, sum(CASE WHEN before + 3600 >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
       SELECT user_id, min(s) AS start, max(e) AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, g""",
)
def candidate_clusters(spark, sf_dir):
    return I.merge(event_spans(spark, sf_dir), ["user_id"], gap=3600)


@query(
    "overlap_sweep",
    f"""WITH {SPANS}, p AS (SELECT user_id, pos, sum(d) AS d FROM (SELECT user_id, s AS pos, 1 AS d FROM spans WHERE s < e UNION ALL SELECT user_id, e, -1 FROM spans WHERE s < e) GROUP BY 1, 2),
       w AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY user_id ORDER BY pos) AS active FROM p)
       SELECT user_id, start, "end", active::BIGINT AS active FROM w WHERE active > 0 AND "end" IS NOT NULL""",
)
def overlap_sweep(spark, sf_dir):
    return I.sweep(event_spans(spark, sf_dir), ["user_id"])


@query(
    "boundary_midpoints",
    f"""WITH {SPANS}, w AS (SELECT event_id, s, e, lag(e) OVER (PARTITION BY user_id ORDER BY s, e) AS pe, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS ns FROM spans),
       r AS (SELECT event_id, s, e, CASE WHEN pe > s THEN (pe + s) / 2.0 ELSE s END::DOUBLE AS a, CASE WHEN ns < e THEN (e + ns) / 2.0 ELSE e END::DOUBLE AS b FROM w)
       SELECT event_id, a AS new_start, b AS new_end, (a <> s OR b <> e) AS adjusted, b - a >= 60 AS kept FROM r""",
)
def boundary_midpoints(spark, sf_dir):
    return I.split_at_midpoints(event_spans(spark, sf_dir), ["user_id"], 60.0).select("event_id", "new_start", "new_end", "adjusted", "kept")


@query(
    "interval_complement",
    f"""WITH {SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans WHERE s < e),
       g AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g),
       c AS (SELECT user_id, e AS s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), 1706745600) AS e FROM g UNION ALL SELECT user_id, 1704067200, min(s) FROM g GROUP BY 1)
       SELECT user_id, greatest(s, 1704067200)::BIGINT AS start, least(e, 1706745600)::BIGINT AS "end" FROM c WHERE greatest(s, 1704067200) < least(e, 1706745600)""",
)
def interval_complement(spark, sf_dir):
    return I.complement(event_spans(spark, sf_dir), ["user_id"], F.lit(1704067200).cast("long"), F.lit(1706745600).cast("long"))


@query(
    "coverage",
    f"""WITH {SPANS}, c AS (SELECT user_id, greatest(0, s - 1704067200) AS s, least(2678400, e - 1704067200) AS e FROM spans), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE s < e),
       g AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g)
       SELECT user_id, round(sum(e - s) / 2678400.0, 8) AS coverage FROM g GROUP BY 1""",
)
def coverage(spark, sf_dir):
    e = event_spans(spark, sf_dir).withColumn("start", F.col("start") - 1704067200).withColumn("end", F.col("end") - 1704067200)
    return rounded(I.coverage(e, ["user_id"], F.lit(2678400)), "coverage", digits=8)


@query(
    "self_overlaps",
    f"""WITH {SPANS} SELECT a.user_id, a.event_id AS l_event_id, b.event_id AS r_event_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap
       FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND a.e > b.s""",
)
def self_overlaps(spark, sf_dir):
    return M.self_overlaps(event_spans(spark, sf_dir), ["user_id"], "event_id", 3600)


# joins and matching


def _views(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", "event_id", micros("ts").alias("at"))


@query(
    "tolerance_join",
    """SELECT v.user_id, v.event_id AS l_event_id, p.event_id AS r_event_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND abs(epoch_us(v.ts) - epoch_us(p.ts)) <= 7200000000""",
)
def tolerance_join(spark, sf_dir):
    return M.within(_views(spark, sf_dir, "view"), _views(spark, sf_dir, "purchase"), ["user_id"], "at", 7200000000).select("user_id", "l_event_id", "r_event_id")


@query(
    "nearest_join",
    """WITH p AS (SELECT v.user_id, v.event_id AS l_key, p.event_id AS r_key, abs(epoch_us(v.ts) - epoch_us(p.ts)) AS distance, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), p.ts, p.event_id) AS r
       FROM events v LEFT JOIN events p ON v.user_id = p.user_id AND p.event_type = 'purchase' WHERE v.event_type = 'view') SELECT user_id, l_key, r_key, distance FROM p WHERE r = 1""",
)
def nearest_join(spark, sf_dir):
    return M.nearest(_views(spark, sf_dir, "view"), _views(spark, sf_dir, "purchase"), ["user_id"], "at", "event_id")


@query(
    "containment_join",
    f"""WITH {SPANS} SELECT p.user_id, p.event_id AS l_event_id, i.event_id AS r_event_id FROM spans p JOIN spans i ON p.user_id = i.user_id AND i.event_type = 'error' AND p.event_type = 'click' AND p.s >= i.s AND p.s <= i.e""",
)
def containment_join(spark, sf_dir):
    e = event_spans(spark, sf_dir)
    points = e.where("event_type = 'click'").select("user_id", "event_id", F.col("start").alias("at"))
    return M.containing(points, e.where("event_type = 'error'").select("user_id", "event_id", "start", "end"), ["user_id"], "at", 3600).select("user_id", "l_event_id", "r_event_id")


@query("anti_join", "SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("semi_join", "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query(
    "vector_nearest",
    """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS r, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM (SELECT * FROM embeddings WHERE vec_id % 10 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id)
       SELECT q AS vec_id, arg_min(r, (d, r)) AS nearest, round(min(d), 6) AS distance FROM p GROUP BY q""",
)
def vector_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(64)]
    flat = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(M.nearest_vector(flat.where("vec_id % 10 = 0"), flat, "vec_id", names, {}, exclude_self=True), "distance")


# The rest have no SQL: sequential or optimal choices within a key.


# sequential rules, written out as one step for each row of a user


@query(
    "greedy_match",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at FROM events),
       p AS (SELECT v.user_id, v.event_id AS l, b.event_id AS r, abs(v.at - b.at) AS d FROM e v JOIN e b ON v.user_id = b.user_id AND v.event_type = 'view' AND b.event_type = 'purchase' AND abs(v.at - b.at) <= 7200000000),
       o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, l, r) AS n FROM p),
       st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS ls, []::BIGINT[] AS rs, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::BIGINT AS d, false AS ok FROM o
              UNION ALL SELECT o.user_id, o.n, CASE WHEN ok_ THEN list_append(ls, o.l) ELSE ls END, CASE WHEN ok_ THEN list_append(rs, o.r) ELSE rs END, o.l, o.r, o.d, ok_
              FROM (SELECT o.*, ls, rs, NOT list_contains(ls, o.l) AND NOT list_contains(rs, o.r) AS ok_ FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1) o)
       SELECT user_id, l AS l_key, r AS r_key, d AS distance FROM st WHERE ok""",
)
def greedy_match(spark, sf_dir):
    return M.greedy_match(_views(spark, sf_dir, "view"), _views(spark, sf_dir, "purchase"), ["user_id"], "at", "event_id", 7200000000)


@query("optimal_match")
def optimal_match(spark, sf_dir):
    e = event_spans(spark, sf_dir)
    return M.optimal_match(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "event_id", 3600.0)


@query(
    "temporal_suppression",
    f"""WITH RECURSIVE {SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM spans),
       st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, s BIGINT, e BIGINT)[] AS kept, NULL::BIGINT AS event_id, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::DOUBLE AS value, NULL::BIGINT AS kept_by FROM o
              UNION ALL SELECT user_id, n, CASE WHEN top >= 0.25 THEN kept ELSE list_append(kept, {{'id': event_id, 's': s, 'e': e}}) END, event_id, s, e, value, CASE WHEN top >= 0.25 THEN kept[list_position(v, top)].id END
              FROM (SELECT *, coalesce(list_max(v), 0) AS top FROM (SELECT o.*, kept, list_transform(kept, lambda k: coalesce(greatest(0, least(o.e, k.e) - greatest(o.s, k.s)) / nullif(greatest(o.e, k.e) - least(o.s, k.s), 0), 0)) AS v
                    FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1)))
       SELECT user_id, event_id, s AS start, e AS "end", value, kept_by FROM st WHERE n > 0""",
)
def temporal_suppression(spark, sf_dir):
    return M.suppress(event_spans(spark, sf_dir), ["user_id"], "event_id", "value", 0.25)


@query(
    "drifting_dedup",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) / 1000000.0 AS "at", value FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e),
       st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(event_id BIGINT, k DOUBLE, "at" DOUBLE, value DOUBLE)[] AS reps FROM o
              UNION ALL SELECT user_id, n, CASE WHEN p IS NULL THEN list_append(reps, one) WHEN value > reps[p].value THEN list_concat(list_concat(reps[1:p - 1], [one]), reps[p + 1:len(reps)]) ELSE reps END
              FROM (SELECT o.user_id, o.n, o.value, reps, {'event_id': o.event_id, 'k': o.k, 'at': o."at", 'value': o.value} AS one, list_position(list_transform(reps, lambda r: abs(o.k - r.k) < 10 AND abs(o."at" - r."at") < 36000), true) AS p
                    FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1)),
       f AS (SELECT user_id, unnest(reps) AS r FROM (SELECT user_id, arg_max(reps, n) AS reps FROM st GROUP BY 1)) SELECT user_id, r.event_id, r.k, r."at", r.value FROM f""",
)
def drifting_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", micros("ts") / 1e6).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return M.drifting_dedup(e, ["user_id"], "event_id", "k", "at", "value", 10.0, 36000.0)


@query(
    "spaced_choice",
    f"""WITH RECURSIVE {SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, s) AS n FROM spans),
       st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS chosen, NULL::BIGINT AS s, NULL::DOUBLE AS value, false AS ok FROM o
              UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(chosen, s) ELSE chosen END, s, value, ok
              FROM (SELECT o.user_id, o.n, o.s, o.value, chosen, len(chosen) < 5 AND coalesce(list_min(list_transform(chosen, lambda c: abs(c - o.s))) >= 86400, true) AS ok FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1))
       SELECT user_id, s AS start, value FROM st WHERE ok""",
)
def spaced_choice(spark, sf_dir):
    return M.spaced_choice(event_spans(spark, sf_dir), ["user_id"], "start", "value", 86400, 5)


# sampling


@query(
    "hash_split",
    """WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1:' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
       SELECT c_custkey, r <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) AS held_out FROM r""",
)
def hash_split(spark, sf_dir):
    return S.split(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "s1", 0.2).select("c_custkey", "held_out")


@query(
    "round_robin",
    """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('rr:' || c_custkey), c_custkey) AS r FROM customer)
       SELECT c_custkey, c_mktsegment, r::BIGINT AS round FROM r ORDER BY r, c_mktsegment, c_custkey LIMIT 60""",
)
def round_robin(spark, sf_dir):
    return S.round_robin(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "rr", 60).select("c_custkey", "c_mktsegment", F.col("round").cast("long").alias("round"))


@query(
    "quota_sample",
    """SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END, sha256('q:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 7""",
)
def quota_sample(spark, sf_dir):
    return S.quota_per_group(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "q", 7, F.col("c_acctbal") > 9000).select("c_custkey")


@query(
    "balanced_sample",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('b:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders)
       SELECT o_orderkey FROM (SELECT *, min(n) OVER (PARTITION BY o_orderpriority) AS least FROM r) WHERE r <= least""",
)
def balanced_sample(spark, sf_dir):
    return S.balanced(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "b").select("o_orderkey")


@query(
    "group_folds",
    """SELECT c_custkey, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('f:' || c_custkey), c_custkey) - 1) % 5)::INT AS fold FROM customer""",
)
def group_folds(spark, sf_dir):
    return S.folds(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", "f", 5).select("c_custkey", "fold")


@query(
    "block_split",
    """WITH b AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('k:' || c_nationkey), c_nationkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM b),
       s AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS q FROM r)
       SELECT c_custkey, CASE WHEN n < 3 THEN 'train' WHEN r <= q THEN 'test' WHEN r <= q + q THEN 'val' ELSE 'train' END AS split FROM customer c JOIN s ON c.c_mktsegment = s.c_mktsegment AND c.c_nationkey = s.c_nationkey""",
)
def block_split(spark, sf_dir):
    return S.block_split(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "k").select("c_custkey", "split")


@query(
    "rotation_pairs",
    """WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
       SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS partner FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND a.n > 1 AND b.r = (a.r + 1 + 7 % (a.n - 1)) % a.n""",
)
def rotation_pairs(spark, sf_dir):
    return S.rotation(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", 7)


@query(
    "latest_turn",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) WHERE r = 1""",
)
def latest_turn(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role")


@query(
    "extremes",
    """SELECT p_brand, 'min' AS role, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1
       UNION ALL SELECT p_brand, 'max', p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1""",
)
def extremes(spark, sf_dir):
    return S.extremes(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey")


@query(
    "stable_seeds",
    """SELECT c_custkey, (('0x' || substr(sha256('42:' || c_custkey), 1, 16))::UBIGINT % 4294967296)::BIGINT AS seed, (('0x' || substr(sha256(c_custkey::VARCHAR), 1, 16))::UBIGINT % 16)::INT AS shard FROM customer""",
)
def stable_seeds(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", X.stable_seed("42", key).alias("seed"), X.stable_shard(key, 16).alias("shard"))


# statistics


@query(
    "spearman",
    """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS y FROM part)
       SELECT p_brand, count(*)::BIGINT AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""",
)
def spearman(spark, sf_dir):
    return rounded(T.spearman(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice"), "rho")


@query(
    "partial_correlation",
    """WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_tax) AS xz, corr(l_extendedprice, l_tax) AS yz FROM lineitem GROUP BY 1)
       SELECT l_returnflag, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS "partial" FROM c""",
)
def partial_correlation(spark, sf_dir):
    return rounded(T.partial_correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_tax"), "partial")


def _predictions(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") > 800).alias("long"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("good", F.col("quality") == 1)


PRED = "p AS (SELECT l.doc_id, d.lang, length(d.text) > 800 AS long, quality = 1 AS good, length(d.text) AS n_text FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(
    "kappa",
    f"""WITH {PRED}, t AS (SELECT lang, count(*)::BIGINT AS n, avg((good = long)::INT) AS agreement, avg(good::INT) AS a, avg(long::INT) AS b FROM p GROUP BY 1), c AS (SELECT *, a * b + (1 - a) * (1 - b) AS chance FROM t)
       SELECT lang, n, round(agreement, 6) AS agreement, round(CASE WHEN chance < 1 THEN (agreement - chance) / (1 - chance) END, 6) AS kappa FROM c""",
)
def kappa(spark, sf_dir):
    return rounded(T.kappa(_predictions(spark, sf_dir), ["lang"], "good", "long"), "agreement", "kappa")


@query(
    "class_scores",
    f"""WITH {PRED}, x AS (SELECT CASE WHEN good THEN 'good' ELSE 'bad' END AS t, CASE WHEN long THEN 'good' ELSE 'bad' END AS p FROM p), l AS (SELECT label, (SELECT count(*) FROM x WHERE t = label AND p = label)::BIGINT AS tp, (SELECT count(*) FROM x WHERE t = label)::BIGINT AS n_true, (SELECT count(*) FROM x WHERE p = label)::BIGINT AS n_predicted FROM (VALUES ('good'), ('bad')) v(label))
       SELECT label, tp, n_true, n_predicted, round(tp / n_predicted, 6) AS precision, round(tp / n_true, 6) AS recall, round(2.0 * tp / (n_true + n_predicted), 6) AS f1 FROM l""",
)
def class_scores(spark, sf_dir):
    p = _predictions(spark, sf_dir).select(F.when(F.col("good"), "good").otherwise("bad").alias("t"), F.when(F.col("long"), "good").otherwise("bad").alias("p"))
    return rounded(T.class_scores(p, "t", "p"), "precision", "recall", "f1")


@query(
    "wilson",
    """WITH c AS (SELECT doc_id % 7 AS g, count(*)::BIGINT AS n, sum(quality)::BIGINT AS k FROM labels GROUP BY 1), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
       SELECT g, n, k, round(CASE WHEN k = 0 THEN 0.0 ELSE greatest(0.0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p * (1 - p) / n + z*z/(4*n*n)) / (1 + z*z/n)) END, 6) AS low,
       round(CASE WHEN k = n THEN 1.0 ELSE least(1.0, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p * (1 - p) / n + z*z/(4*n*n)) / (1 + z*z/n)) END, 6) AS high FROM w""",
)
def wilson(spark, sf_dir):
    c = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 7).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    w = X.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("g", "n", "k", w["low"].alias("low"), w["high"].alias("high")), "low", "high")


_BINS = [0.0, 500.0, 1000.0, 2000.0, 4000.0, 1e6]


@query(
    "binned_accuracy",
    f"""WITH {PRED}, b AS (SELECT CASE WHEN n_text < 500 THEN 0 WHEN n_text < 1000 THEN 1 WHEN n_text < 2000 THEN 2 WHEN n_text < 4000 THEN 3 ELSE 4 END AS bin, good = long AS ok FROM p)
       SELECT bin::INT AS bin, count(*)::BIGINT AS n, round(avg(ok::INT), 6) AS accuracy FROM b GROUP BY 1""",
)
def binned_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("n_text"))
    p = _predictions(spark, sf_dir).join(d, "doc_id")
    return rounded(T.binned_accuracy(p, [], X.bin_index(F.col("n_text"), _BINS), F.col("good") == F.col("long")), "accuracy")


@query(
    "sustained_threshold",
    """WITH b AS (SELECT event_type, day(ts)::INT AS x, avg(value) AS y FROM events GROUP BY 1, 2), s AS (SELECT *, min(y) OVER (PARTITION BY event_type ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 15 AS ok FROM b)
       SELECT event_type, min(CASE WHEN ok THEN x END) AS threshold FROM s GROUP BY 1""",
)
def sustained_threshold(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("x")).agg(F.avg("value").alias("y"))
    return T.sustained_crossing(b, ["event_type"], "x", "y", 15.0)


@query(
    "first_threshold",
    """WITH b AS (SELECT event_type, day(ts)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY 1, 2), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM b WINDOW w AS (PARTITION BY event_type ORDER BY x)),
       h AS (SELECT event_type, x, CASE WHEN y >= 22 AND (py IS NULL OR py < 22) THEN CASE WHEN py IS NULL OR y = py THEN x ELSE px + (22 - py) * (x - px) / (y - py) END END AS pos FROM s)
       SELECT event_type, round(arg_min(pos, x) FILTER (pos IS NOT NULL), 6) AS threshold FROM h GROUP BY 1""",
)
def first_threshold(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return rounded(T.first_crossing(b, ["event_type"], "x", "y", 22.0), "threshold")


@query(
    "count_proxy",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS t FROM events GROUP BY 1), s AS (SELECT sum(least(p, t))::BIGINT AS tp, sum(greatest(p - t, 0))::BIGINT AS fp, sum(greatest(t - p, 0))::BIGINT AS fn, round(avg(abs(p - t)), 6) AS mae FROM c)
       SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
)
def count_proxy(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("p"), F.count_if(F.col("event_type") == "click").alias("t"))
    return rounded(T.count_proxy(c, [], "p", "t"), "mae", "precision", "recall", "f1")


@query(
    "stratum_weights",
    """WITH p AS (SELECT o_orderstatus, count(*)::BIGINT AS population FROM orders GROUP BY 1), r AS (SELECT o_orderstatus, count(*)::BIGINT AS reviewed FROM orders WHERE o_orderkey % 11 = 0 GROUP BY 1)
       SELECT p.o_orderstatus, population, reviewed, round(population / reviewed, 6) AS weight FROM p JOIN r ON p.o_orderstatus = r.o_orderstatus""",
)
def stratum_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(T.stratum_weights(o, o.where("o_orderkey % 11 = 0"), ["o_orderstatus"]), "weight")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    return T.cluster_bootstrap(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value", 200, 7)


@query("marginal_mode")
def marginal_mode(spark, sf_dir):
    return T.grouped_array(table(spark, sf_dir, "part"), ["p_brand"], ["p_retailprice"], "mode double", lambda a: {"mode": T.kde_mode(a["p_retailprice"])})


# arrays


@query(
    "decimated",
    """SELECT vec_id, j::INT AS j, round(list_avg(list_slice(embedding::DOUBLE[], j * 4 + 1, j * 4 + 4)), 6) AS mean FROM embeddings, (SELECT unnest(range(0, 16)) AS j)""",
)
def decimated(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", X.decimate_mean(F.col("embedding").cast("array<double>"), 4).alias("d"))
    return rounded(e.select("vec_id", F.posexplode("d").alias("j", "mean")), "mean")


@query(
    "window_energy",
    """WITH w AS (SELECT vec_id, s, list_sum(list_transform(list_slice(embedding::DOUBLE[], s + 1, s + 16), lambda x: x * x)) AS energy FROM embeddings, (SELECT unnest([0, 8, 16, 24, 32, 40, 48]) AS s))
       SELECT vec_id, s::INT AS start, round(energy, 6) AS energy FROM w""",
)
def window_energy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    w = e.select("vec_id", "a", F.explode(I.grid_windows(F.size("a"), 16, 8)).alias("start"))
    energy = F.aggregate(F.slice("a", F.col("start") + 1, F.lit(16)), F.lit(0.0), lambda s, x: s + x * x)
    return rounded(w.select("vec_id", "start", energy.alias("energy")), "energy")


@query(
    "z_scored",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), t AS (SELECT vec_id, a, m, sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))) AS sd FROM s)
       SELECT vec_id, i::INT AS i, round((a[i + 1] - m) / sd, 6) AS z FROM t, (SELECT unnest(range(0, 64)) AS i)""",
)
def z_scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", X.z_scored(F.col("embedding").cast("array<double>")).alias("z"))
    return rounded(e.select("vec_id", F.posexplode("z").alias("i", "z")), "z")


# windows in time


@query(
    "hopping_windows",
    """WITH w AS (SELECT unnest([epoch_us(ts) // 21600000000 * 21600000000, epoch_us(ts) // 21600000000 * 21600000000 - 21600000000]) AS s, event_type, value FROM events)
       SELECT s // 1000000 AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
)
def hopping_windows(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(w.select((micros("w.start") / 1000000).cast("long").alias("start"), "event_type", "n", "total"), "total", digits=4)


@query(
    "session_windows",
    """WITH o AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 14400000000 THEN 0 ELSE 1 END AS f FROM o), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS g FROM f)
       SELECT user_id, min(t) AS first, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""",
)
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.min(micros("ts")).alias("first"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(e.select("user_id", "first", "n", "total"), "total", digits=4)


# traces: one for each supplier, made of its balance; detection has no SQL


#: Traces in a task, about; what a task holds does not grow with the table. They are filtered side by side: half as many take half as long again for each.
TRACES = 512


def spread_suppliers(spark, sf_dir: str) -> DataFrame:
    """Suppliers dealt to tasks by key. Their rows are small and come in few files, but a trace costs far more than its row: it is made where its task is."""
    s = table(spark, sf_dir, "supplier")
    return s.repartition(max(spark.sparkContext.defaultParallelism, -(-s.count() // TRACES)), "s_suppkey")


#: Samples of a supplier's trace.
SAMPLES = 4096


def supplier_sample(i: Column) -> Column:
    """Sample ``i`` of a Gaussian burst whose place, frequency and width follow the supplier's key, over a faint hum."""
    key = F.col("s_suppkey")
    burst = X.gaussian_at(i, 2e6, F.lit(1.0), 20000.0 + F.pmod(key, F.lit(30)) * 1000.0, F.lit(1e-4), 1000.0 + F.pmod(key * 37, F.lit(2000)), F.lit(0.0))
    return burst + 0.001 * F.sin(i * i * 0.37 + key)


def supplier_samples(spark, sf_dir: str) -> D.Sampled:
    """A trace for each supplier, packed by the operator that uses it."""
    return D.Sampled(spread_suppliers(spark, sf_dir).select("s_suppkey"), "signal", SAMPLES, supplier_sample)


def supplier_traces(spark, sf_dir: str) -> DataFrame:
    """``supplier_samples`` as a table. What it meets should meet ``spread_suppliers`` before: ``sampled_traces`` does not tell Spark how its rows are dealt."""
    return D.sampled_traces(spread_suppliers(spark, sf_dir).select("s_suppkey"), "signal", SAMPLES, supplier_sample)


def supplier_arrays(spark, sf_dir: str) -> DataFrame:
    """The traces of ``supplier_traces`` by one expression: slower, but an operator that joins them by key need not move them."""
    return spread_suppliers(spark, sf_dir).select("s_suppkey", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), supplier_sample).alias("signal"))


@query("detected_events")
def detected_events(spark, sf_dir):
    return D.detect_events(supplier_samples(spark, sf_dir), "s_suppkey", "signal")


@query("sliding_spectra")
def sliding_spectra(spark, sf_dir):
    return D.sliding_spectra(supplier_samples(spark, sf_dir), "s_suppkey", "signal", width=1024, stride=256)


@query("noise_summary")
def noise_summary(spark, sf_dir):
    return D.noise_summary(supplier_samples(spark, sf_dir), "s_suppkey", "signal")


@query("peak_groups")
def peak_groups(spark, sf_dir):
    return D.peak_groups(supplier_samples(spark, sf_dir), "s_suppkey", "signal")


@query("temporal_energy")
def temporal_energy(spark, sf_dir):
    return D.temporal_energy(supplier_samples(spark, sf_dir), "s_suppkey", "signal")


@query("saturation_scan")
def saturation_scan(spark, sf_dir):
    return D.saturation(supplier_samples(spark, sf_dir), "s_suppkey", "signal", least=200, level=1e-3)


@query("event_descriptors")
def event_descriptors(spark, sf_dir):
    return D.descriptors(supplier_samples(spark, sf_dir), "s_suppkey", "signal", 2e6)


@query("band_energy")
def band_energy(spark, sf_dir):
    return D.band_energy(supplier_samples(spark, sf_dir), "s_suppkey", "signal", 2e6, [("low", 0.0, 7e3), ("band", 7e3, 8e4), ("high", 8e4, 1e6)])
