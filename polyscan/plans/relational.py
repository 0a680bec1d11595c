"""Relational queries over the Parquet tables, in Spark SQL and the DuckDB dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyscan.operators import joins
from polyscan.registry import register, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose text is the same in both dialects, or has an oracle of its own."""

    @register(name, oracle or sql)
    def run(spark, sf_dir):
        text = sql
        for t in TABLES:
            text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
        return spark.sql(text)


def both(name: str, sql: str, spark_only: dict[str, str] | None = None) -> None:
    """Table names stand in braces; spark_only: what Spark writes in another way."""
    oracle = sql
    for t in TABLES:
        oracle = oracle.replace("{" + t + "}", t)
    spark_text = sql
    for a, b in (spark_only or {}).items():
        spark_text = spark_text.replace(a, b)
    sql_query(name, spark_text, oracle)


# --- scans, projections, predicates
both("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CASE WHEN 30 <= l_quantity THEN 'many' ELSE 'few' END AS kind FROM {lineitem} WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND l_quantity >= 10 AND 0.02 < l_discount AND l_returnflag <> 'A'")
both("predicate_null_in_like", "SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS priority FROM {orders} WHERE o_orderstatus IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 1000 OR o_orderpriority LIKE '3%') AND nullif(o_orderstatus, 'P') IS NOT NULL")
both("count_star", "SELECT count(*) AS n FROM {lineitem}")
# --- joins
both("join_inner_using", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM {customer}) c USING (o_custkey) GROUP BY c_mktsegment")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
both("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 300000")
both("join_anti_pattern", "SELECT c_custkey, c_name FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NULL")
both("join_semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("join_in_subquery", "SELECT count(*) AS n FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')")
both("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) b ON a.k = b.k")
both("join_cross_const", "SELECT r_name, t.total FROM {region} LEFT JOIN (SELECT count(*) AS total FROM {nation}) t ON true")
both("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE r.r_regionkey <> n.n_regionkey")
both("join_literal_side", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey AND r_name = 'ASIA'")
both("join_3way", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")


@register(
    "join_theta_interval",
    """SELECT a.event_id AS event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id
       WHERE a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 90 * 1000000::BIGINT""",
)
def join_theta_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = joins.interval_join(e, e, ["user_id"], "ts", "ts", 90)
    return found.where("event_id < event_id_right").select("event_id", F.col("event_id_right").alias("other"))


@register(
    "join_asof",
    """SELECT p.event_id AS event_id, v.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(left, right, ["user_id"], "ts", "ts", ["value"]).select("event_id", "value")


@register("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def join_salted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return joins.salted_join(l, o, "k", 4).groupBy("l_returnflag").agg(F.count("*").alias("n"))


# --- aggregates
both("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM {orders} GROUP BY o_orderpriority")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
both("agg_ordinal_expr", "SELECT CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END AS kind, p_brand, count(*) AS n FROM {part} GROUP BY 1, p_brand")
both("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS large, round(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 4) AS tax FROM {lineitem} GROUP BY l_linestatus")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("agg_any_value", "SELECT n_regionkey, count(n_name) AS n, any_value(n_regionkey) AS any_key FROM {nation} GROUP BY n_regionkey")
both("agg_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS sd, round(variance(l_quantity), 4) AS var, round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_samp(l_quantity, l_tax), 6) AS cov, round(median(l_quantity), 4) AS med, bool_and(l_quantity > 0) AS all_pos, bool_or(l_quantity > 49) AS some_big FROM {lineitem} GROUP BY l_returnflag")
both("agg_distinct_over_group", "SELECT DISTINCT count(*) AS n FROM {customer} GROUP BY c_nationkey")
both("agg_string_list", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", {"string_agg(n_name, ',' ORDER BY n_name)": "listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)"})
# --- windows
both("window_deviation", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 4) AS dev FROM {events}")
both("window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
both("window_lag", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, 0) OVER w AS after, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", {"lead(value, 2, 0)": "lead(value, 2, 0D)"})
both("window_running_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM {orders}")
# --- order and limits
both("topk_nulls_last", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p, o_totalprice FROM {orders} ORDER BY p DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 25")
both("topk_by_expression", "SELECT l_orderkey, l_linenumber, l_tax - l_discount AS gap FROM {lineitem} ORDER BY abs(gap) DESC, l_orderkey, l_linenumber LIMIT 20")
both("limit_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 15")
both("distinct", "SELECT DISTINCT p_brand, p_size FROM {part}")
# --- sets and common table expressions
both("setop_union", "SELECT n_name AS name FROM {nation} UNION SELECT r_name FROM {region} UNION ALL SELECT r_name FROM {region}")
both("setop_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}")
both("setop_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 3000")
both("setop_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
both("cte_chain", "WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), big AS (SELECT k, total FROM spent WHERE total > 500000) SELECT c_nationkey, count(*) AS n, round(max(total), 2) AS most FROM big JOIN {customer} ON k = c_custkey GROUP BY c_nationkey")
# --- scalar functions
both("fn_string", "SELECT p_partkey, upper(p_name) AS u, substr(p_type, 1, 5) AS s, replace(p_brand, '#', '-') AS r, lpad(CAST(p_size AS VARCHAR(10)), 4, '0') AS l, rpad(p_brand, 12, '.') AS rp, trim('  ' || p_type || ' ') AS t, concat(p_brand, '/', p_type) AS c, length(p_name) AS n, reverse(p_brand) AS rev, starts_with(p_name, 'a') AS sw, position('#' IN p_brand) AS pos, split_part(p_type, ' ', 1) AS sp FROM {part}", {"starts_with(": "startswith(", "CAST(p_size AS VARCHAR(10))": "CAST(p_size AS STRING)"})
both("fn_string_regex", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_type, '[aeiou]', '_', 'g') AS masked, regexp_matches(p_name, '^[a-m]') AS early FROM {part}", {", '_', 'g')": ", '_')", "regexp_matches(": "regexp_like("})
both("fn_date_interval", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(doy FROM o_orderdate) AS INT) AS doy, o_orderdate + INTERVAL '6 hour' AS later FROM {orders} WHERE o_orderdate >= DATE '1995-06-01'", {"date_trunc('month', o_orderdate)": "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ)", "INTERVAL '6 hour'": "INTERVAL '6' HOUR"})
both("fn_cast_case", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS DOUBLE) / 2 AS half, TRY_CAST(l_returnflag AS INT) AS bad, coalesce(nullif(l_returnflag, 'N'), '?') AS flag, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo FROM {lineitem}")
both("fn_math", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS fl, ceil(l_tax * 10) AS ce, abs(l_tax - l_discount) AS ab, round(power(l_quantity, 2), 2) AS sq, round(sqrt(l_extendedprice), 4) AS rt, round(ln(l_quantity), 6) AS lg, round(log10(l_quantity), 6) AS lt, sign(l_discount - 0.05) AS sg, l_linenumber % 3 AS md FROM {lineitem}", {"floor(l_extendedprice)": "CAST(floor(l_extendedprice) AS DOUBLE)", "ceil(l_tax * 10)": "CAST(ceil(l_tax * 10) AS DOUBLE)", "sign(l_discount - 0.05)": "CAST(sign(l_discount - 0.05D) AS TINYINT)"})
both("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM {customer}", {"sha256(c_name)": "sha2(c_name, 256)"})
both("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.v') AS v FROM {events}", {"json_extract_string(": "get_json_object("})
both("fn_array", "SELECT n_regionkey, len(list(n_name)) AS n, list_contains(list(n_name), 'FRANCE') AS has FROM {nation} GROUP BY n_regionkey", {"len(list(n_name))": "CAST(size(collect_list(n_name)) AS BIGINT)", "list_contains(list(n_name), 'FRANCE')": "array_contains(collect_list(n_name), 'FRANCE')"})
both("fn_unnest", "SELECT n_name, x FROM {nation}, unnest([n_nationkey, n_regionkey]) AS t(x)", {", unnest([n_nationkey, n_regionkey]) AS t(x)": " LATERAL VIEW explode(array(n_nationkey, n_regionkey)) t AS x"})
both("fn_series", "SELECT CAST(x AS BIGINT) AS x, CAST(x * x AS BIGINT) AS sq FROM generate_series(1, 100) t(x)", {"generate_series(1, 100) t(x)": "(SELECT explode(sequence(1, 100)) AS x) t"})
both("fn_epoch", "SELECT event_id, epoch_us(ts) AS us FROM {events}", {"epoch_us(ts)": "unix_micros(CAST(ts AS TIMESTAMP))"})
both("fn_date_bin", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS n FROM {events} GROUP BY 1", {"time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')": "CAST(window(ts, '15 minutes').start AS TIMESTAMP_NTZ)"})
both("fn_map_struct", "SELECT event_id, list_extract(element_at(MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)}, 'type'), 1) AS kind, CAST(cardinality(MAP {'a': user_id, 'b': event_id}) AS INT) AS n, struct_extract(struct_pack(u := user_id, v := value), 'v') AS v FROM {events}", {"list_extract(element_at(MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)}, 'type'), 1)": "element_at(map('type', event_type, 'user', CAST(user_id AS STRING)), 'type')", "MAP {'a': user_id, 'b': event_id}": "map('a', user_id, 'b', event_id)", "struct_extract(struct_pack(u := user_id, v := value), 'v')": "named_struct('u', user_id, 'v', value).v"})
both("fn_encode", "SELECT c_custkey, base64(encode(c_name)) AS b64, hex(c_name) AS hx, decode(from_base64(base64(encode(c_mktsegment)))) AS back FROM {customer}", {"base64(encode(c_name))": "base64(encode(c_name, 'UTF-8'))", "decode(from_base64(base64(encode(c_mktsegment))))": "decode(unbase64(base64(encode(c_mktsegment, 'UTF-8'))), 'UTF-8')"})
both("fn_time_parse", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M') AS parsed, make_timestamp(o_orderkey * 1000000) AS from_unix, o_orderdate < now() AS past, current_date > CAST(o_orderdate AS DATE) AS before_today FROM {orders}", {"strptime(strftime(o_orderdate, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M')": "CAST(to_timestamp(date_format(o_orderdate, 'yyyy/MM/dd HH:mm'), 'yyyy/MM/dd HH:mm') AS TIMESTAMP_NTZ)", "make_timestamp(o_orderkey * 1000000)": "CAST(timestamp_seconds(o_orderkey) AS TIMESTAMP_NTZ)", "o_orderdate < now()": "o_orderdate < CAST(now() AS TIMESTAMP_NTZ)", "current_date >": "current_date() >"})
# --- shapes of everyday reports
both("recon_status_case", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'items_missing' WHEN abs(o_totalprice - total) > 50000 THEN 'amount_drift' ELSE 'ok' END AS status, round(coalesce(total, 0), 2) AS total FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS total FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY l_orderkey) l ON o_orderkey = l_orderkey")
both("login_storm", "SELECT user_id, count(*) AS n, max(value) AS top FROM {events} WHERE event_type = 'click' GROUP BY user_id HAVING count(*) >= 5")
both("usage_ratio", "SELECT c_mktsegment, round(sum(o_totalprice) / nullif(count(DISTINCT c_custkey), 0), 2) AS per_head, round(CAST(count(*) AS DOUBLE) / count(DISTINCT c_custkey), 4) AS orders_each FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment")


#: Bounds of the sketches: relative error of the distinct count (3 standard errors of 2 %), and of the median's rank, which is a whole row.
COUNT_ERROR, RANK_ERROR = 0.06, 0.001


@register(
    "agg_approx",
    "SELECT o_orderstatus, count(*) AS n, true AS customers_near, true AS median_near FROM orders GROUP BY o_orderstatus",
)
def agg_approx(spark, sf_dir):
    """Sketches of distinct customers and of the median price, held in Spark against the exact values: near if in bounds."""
    o = table(spark, sf_dir, "orders")
    found = o.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", COUNT_ERROR / 3).alias("customers"), F.percentile_approx("o_totalprice", 0.5, int(1 / RANK_ERROR)).alias("price"))
    exact = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("real"))
    below = o.join(found, "o_orderstatus").groupBy("o_orderstatus").agg(F.avg((F.col("o_totalprice") < F.col("price")).cast("double")).alias("low"), F.avg((F.col("o_totalprice") <= F.col("price")).cast("double")).alias("high"))
    near = F.abs(F.col("customers") - F.col("real")) <= COUNT_ERROR * F.col("real")
    slack = RANK_ERROR + 1 / F.col("n")
    middle = (F.col("low") - slack <= 0.5) & (F.col("high") + slack >= 0.5)
    return found.join(exact, "o_orderstatus").join(below, "o_orderstatus").select("o_orderstatus", "n", near.alias("customers_near"), middle.alias("median_near"))
