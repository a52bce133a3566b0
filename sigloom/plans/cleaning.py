"""Queries that clean traces and tell blended events apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cleaning as L
from ..operators import detectors as D
from .queries import rounded, supplier_arrays, supplier_samples, table
from .registry import query


@query(
    "cleaning_actions",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s, e) - 1 AS nth, s AS start, e AS "end", e - s AS length, 'masked' AS action FROM (SELECT user_id, event_id * 10 AS s, event_id * 10 + 5 AS e FROM events WHERE event_type = 'error')""",
)
def cleaning_actions(spark, sf_dir):
    spans = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    return L.actions(spans, "user_id", "mask").withColumn("nth", F.col("nth").cast("long"))


_SIGNAL = "x AS (SELECT l_suppkey, l_quantity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i FROM lineitem)"


def quantity_traces(spark, sf_dir):
    """A trace for each supplier: the quantities of its lines in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("rows"))
    return lines.select("l_suppkey", F.col("rows.l_quantity").alias("signal"))


@query(
    "masked_traces",
    f"""WITH {_SIGNAL} SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(CASE WHEN (i >= 3 AND i < 7) OR (i >= 10 AND i < 11) THEN -1 ELSE l_quantity END), 6) AS total FROM x GROUP BY 1""",
)
def masked_traces(spark, sf_dir):
    spans = F.expr("array(named_struct('start', 3, 'end', 7), named_struct('start', 10, 'end', 11))")
    t = quantity_traces(spark, sf_dir).withColumn("clean", L.masked(F.col("signal"), spans, -1.0))
    return rounded(t.select("l_suppkey", F.size("clean").cast("long").alias("n"), F.aggregate("clean", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query(
    "replaced_traces",
    f"""WITH {_SIGNAL} SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(CASE WHEN (i >= 2 AND i < 5) OR (i >= 8 AND i < 9) THEN 7.5 ELSE l_quantity END), 6) AS total FROM x GROUP BY 1 HAVING count(*) >= 9""",
)
def replaced_traces(spark, sf_dir):
    t = quantity_traces(spark, sf_dir).where(F.size("signal") >= 9)
    spans = t.select("l_suppkey", F.explode(F.expr("array(named_struct('start', 2, 'end', 5), named_struct('start', 8, 'end', 9))")).alias("s")).select("l_suppkey", "s.*")
    pool = spark.range(4).select(F.col("id").cast("int").alias("number"), F.expr("array_repeat(7.5D, 2)").alias("noise"))
    t = L.replaced(t, L.with_carriers(spans, pool, "l_suppkey", "p", 4), "l_suppkey", "signal")
    return rounded(t.select("l_suppkey", F.size("clean").cast("long").alias("n"), F.aggregate("clean", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("repaired_traces")
def repaired_traces(spark, sf_dir):
    t = supplier_arrays(spark, sf_dir)
    carrier = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: 0.001 * F.cos(i * 0.2))
    regions = t.select("s_suppkey", F.lit(500).alias("outer_start"), F.lit(900).alias("outer_end"), F.lit(600).alias("core_start"), F.lit(800).alias("core_end"), carrier.alias("carrier"))
    done = L.repaired(t, regions, "s_suppkey", "signal", domain="filtered")
    rms = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c))
    return rounded(done.select("s_suppkey", "regions", "problem", rms("clean").alias("clean_rms"), rms("filtered").alias("filtered_rms")), "clean_rms", "filtered_rms")


@query("deblended_events")
def deblended_events(spark, sf_dir):
    return D.deblended_events(supplier_samples(spark, sf_dir), "s_suppkey", "signal")


@query(
    "rescued_candidates",
    """WITH c AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS center, value AS frequency, value AS z, CASE WHEN event_type = 'purchase' THEN 'strict' ELSE 'reject' END AS quality, CASE WHEN event_type = 'click' THEN 'weak' ELSE '' END AS reason FROM events),
       w AS (SELECT *, last_value(CASE WHEN quality = 'strict' THEN {'c': center, 'f': frequency} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY center, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
             first_value(CASE WHEN quality = 'strict' THEN {'c': center, 'f': frequency} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY center, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM c)
       SELECT CASE WHEN reason = 'weak' AND z >= 4 AND (coalesce(abs(center - b.c) <= 20000 AND abs(frequency - b.f) <= 15, false) OR coalesce(abs(center - a.c) <= 20000 AND abs(frequency - a.f) <= 15, false)) THEN 'rescued' ELSE quality END AS quality, count(*)::BIGINT AS n FROM w GROUP BY 1""",
)
def rescued_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")) / 1000000)
    c = e.select("user_id", F.col("event_id").alias("candidate"), seconds.alias("center"), F.col("value").alias("frequency"), F.col("value").alias("z"), F.when(F.col("event_type") == "purchase", "strict").otherwise("reject").alias("quality"), F.when(F.col("event_type") == "click", "weak").otherwise("").alias("reason"))
    return D.rescued(c, "user_id", 20000.0, 15.0, 4.0).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


# facts about names, structures and parameters


@query(
    "parsed_names",
    """SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 1) AS kind, TRY_CAST(nullif(regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 2), '') AS BIGINT) AS number FROM customer""",
)
def parsed_names(spark, sf_dir):
    pattern = "^([A-Za-z]+)#([0-9]+)$"
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", pattern, 1).alias("kind"), F.expr(f"try_cast(nullif(regexp_extract(c_name, '{pattern}', 2), '') as bigint)").alias("number"))


@query(
    "ranked_pairs",
    """WITH p AS (SELECT l_returnflag, unnest(['quantity', 'quantity', 'price']) AS a, unnest(['price', 'discount', 'discount']) AS b, unnest([l_quantity, l_quantity, l_extendedprice]) AS x, unnest([l_extendedprice, l_discount, l_discount]) AS y FROM lineitem),
       c AS (SELECT l_returnflag, a, b, round(corr(x, y), 6) AS r FROM p GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(r) DESC, a, b)::INT AS place FROM c""",
)
def ranked_pairs(spark, sf_dir):
    cols = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    names = list(cols)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.corr(cols[a], cols[b]), 6).alias(f"{a}_{b}") for a, b in pairs])
    told = one.select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])).alias("p")).select("l_returnflag", "p.*")
    return told.withColumn("place", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc(F.abs("r")), "a", "b")))


@query(
    "dominant_band",
    """WITH b AS (SELECT user_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS band, sum(value) AS total FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, band) AS r, sum(total) OVER (PARTITION BY user_id) AS whole FROM b)
       SELECT user_id, band, round(total / whole, 6) AS share FROM r WHERE r = 1""",
)
def dominant_band(spark, sf_dir):
    band = F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high")
    by = table(spark, sf_dir, "events").groupBy("user_id", band.alias("band")).agg(F.sum("value").alias("total"))
    first = Window.partitionBy("user_id").orderBy(F.desc(F.round("total", 6)), "band")
    got = by.withColumn("r", F.row_number().over(first)).withColumn("whole", F.sum("total").over(Window.partitionBy("user_id"))).where("r = 1")
    return rounded(got.select("user_id", "band", (F.col("total") / F.col("whole")).alias("share")), "share")


@query(
    "violations",
    """WITH v AS (SELECT o_orderkey, unnest([CASE WHEN o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN c_custkey IS NULL THEN 'owner' END]) AS rule FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
       SELECT rule, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM v WHERE rule IS NOT NULL GROUP BY 1""",
)
def violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = {"price": F.col("o_totalprice") <= 1000, "status": ~F.col("o_orderstatus").isin("O", "F"), "owner": F.col("c_custkey").isNull()}
    told = o.select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("rule"))
    return told.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query(
    "flattened_fields",
    """SELECT event_id, unnest(json_keys(props)) AS field, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events""",
)
def flattened_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@query(
    "combined_index",
    """WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS v, 'orders' AS origin FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END, 'customer' FROM customer)
       SELECT k AS key, count(*)::BIGINT AS origins, min(v) AS value, count(DISTINCT v) > 1 AS conflict FROM a GROUP BY 1""",
)
def combined_index(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("v"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, "O").otherwise("F").alias("v"))
    return a.union(b).groupBy("key").agg(F.count(F.lit(1)).alias("origins"), F.min("v").alias("value"), (F.min("v") != F.max("v")).alias("conflict"))


@query(
    "standard_parameters",
    """WITH l AS (SELECT l_returnflag, ln(l_extendedprice) AS x, ln(l_quantity) AS y FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0), s AS (SELECT l_returnflag, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM l GROUP BY 1)
       SELECT l_returnflag, round(min((x - mx) / sx), 5) AS low, round(max((x - mx) / sx), 5) AS high, round(avg((x - mx) / sx * (y - my) / sy), 5) AS joint FROM l JOIN s USING (l_returnflag) GROUP BY 1""",
)
def standard_parameters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0 and l_quantity > 0").select("l_returnflag", F.log("l_extendedprice").alias("x"), F.log("l_quantity").alias("y"))
    s = l.groupBy("l_returnflag").agg(*[f(c).alias(n + c) for c in ("x", "y") for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = lambda c: (F.col(c) - F.col("m" + c)) / F.col("s" + c)
    return rounded(l.join(F.broadcast(s), "l_returnflag").groupBy("l_returnflag").agg(F.min(z("x")).alias("low"), F.max(z("x")).alias("high"), F.avg(z("x") * z("y")).alias("joint")), "low", "high", "joint", digits=5)


@query(
    "alignment_factor",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) SELECT a.event_type, round(b.m / nullif(a.m, 0), 6) AS factor FROM m a, (SELECT m FROM m WHERE event_type = 'view') b""",
)
def alignment_factor(spark, sf_dir):
    middle = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    to = F.max(F.when(F.col("event_type") == "view", F.col("m"))).over(Window.partitionBy(F.lit(1)))  # a row for each type
    return rounded(middle.select("event_type", (to / F.nullif("m", F.lit(0.0))).alias("factor")), "factor")


@query(
    "source_shuffle",
    """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('sh:' || s_suppkey), s_suppkey)::INT AS turn FROM supplier""",
)
def source_shuffle(spark, sf_dir):
    from ..operators.sampling import ranked

    return ranked(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "sh", "turn").select("s_suppkey", "turn")


@query(
    "common_samples",
    """SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'""",
)
def common_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "signup"))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n = 3").select("user_id")
