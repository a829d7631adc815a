"""Canonical retention views over the driver tables (see FIXTURES.md §3).

Each view is a DataFrame builder. The same definitions are kept as SQL text
(`VIEW_SQL`) so the DuckDB oracle can rebuild them as CTEs; the two forms are
checked against each other by the correctness gate.

Scale notes: orders are pre-aggregated per customer / per order *before* they
meet the customer or order side, so each join sees at most one row per key;
nation and region are fixed 25- and 5-row dimensions that the planner
broadcasts on its own size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

# Fixed as-of dates of the driver data (never the clock).
ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
TASK_LINES = 500_000  # order lines that one task adds up


def as_of_lit(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


def customers(t: Tables) -> DataFrame:
    o = (t.orders.groupBy("o_custkey")
         .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")))
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    c = (t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(o, F.col("o_custkey") == F.col("c_custkey"), "left"))
    nk = F.col("n_nationkey") % 5
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("email"),
        F.when(nk == 0, "US").when(nk == 1, "UK").when(nk == 2, "DE").when(nk == 3, "IN")
         .otherwise("BR").alias("country"),
        F.col("r_name").alias("region"),
        F.col("first_order").alias("signup_date"),
        F.when(F.col("c_acctbal") < 0, "closed").otherwise("active").alias("account_status"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "VIP")
         .when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Regular")
         .otherwise("New").alias("customer_segment"),
        F.when(F.col("c_custkey") % 3 == 0, "Web").when(F.col("c_custkey") % 3 == 1, "Mobile")
         .otherwise("App").alias("device_type"),
        F.when(F.col("c_custkey") % 4 == 0, "Organic").when(F.col("c_custkey") % 4 == 1, "Paid")
         .when(F.col("c_custkey") % 4 == 2, "Referral").alias("signup_source"),
        F.when(F.col("c_acctbal") < 0, F.col("last_order")).alias("deleted_at"),
    )


def type_codes(t: Tables) -> DataFrame:
    """(p_type, code): the part types numbered in alphabetical order. One row
    per type, so the numbering window stays small however many parts there are."""
    return t.part.select("p_type").distinct() \
        .select("p_type", F.row_number().over(Window.orderBy("p_type")).alias("code"))


def line_tasks(t: Tables) -> int:
    """Tasks that meet orders with their lines: as many more as there are lines,
    so that what one task holds doesn't grow (a count of lines reads footers)."""
    return max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // TASK_LINES))


def order_lines(t: Tables, orders: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Per-order line attributes: one row per l_orderkey (partial aggregation
    first, or with `tasks` in so many tasks, where the lines of an order meet).
    `orders` (o_orderkey) restricts the lines before they meet parts.
    The smallest type is taken over its number: a string minimum would make
    Spark sort all lines instead of hashing them."""
    lines = t.lineitem
    if orders is not None:
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    codes = type_codes(t)
    parts = t.part.join(codes, "p_type").select("p_partkey", "code")
    lines = lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    if tasks:
        lines = lines.select("l_orderkey", "code", "l_returnflag", "l_linestatus", "l_discount").repartition(tasks, "l_orderkey")
    g = (lines.groupBy("l_orderkey")
         .agg(F.min("code").alias("code"),
              F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 1)
                    .otherwise(0)).alias("refund"),
              F.min(F.when(F.col("l_discount") > 0.02, 1).otherwise(0)).alias("discounted")))
    return g.join(codes, "code").select("l_orderkey", F.col("p_type").alias("category"), "refund", "discounted")


def line_categories(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """(l_orderkey, p_type) per order line (lineitem joined with part);
    `orders` (transaction_id) restricts the lines before they meet parts."""
    lines = t.lineitem
    if orders is not None:
        lines = lines.join(orders.select("transaction_id"), F.col("l_orderkey") == F.col("transaction_id"), "left_semi")
    return lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_type")


def transactions(t: Tables, lines: bool = True, where=None, prune: bool = True) -> DataFrame:
    """Order-level transactions. `where` (a condition on the order's columns,
    e.g. o_orderdate) prunes orders, and their lines, first; `prune=False` leaves
    the lines, for a condition that most orders meet: sorting all lines to find
    the few that go takes more time and memory than adding them up. `lines=False` skips the lineitem join for
    callers that read only order columns (the line attributes then take the
    view's absent-line defaults, which is what they are for orders without lines
    but not in general — only use it when those columns are not read)."""
    o = t.orders if where is None else t.orders.filter(where)
    base = [F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("order_amount")]
    rest = [F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderstatus").alias("shipping_status")]
    if not lines:
        return o.select(*base, *rest)
    if where is not None and prune:
        per_order = order_lines(t, o)
    else:
        tasks = line_tasks(t)
        o, per_order = o.repartition(tasks, "o_orderkey"), order_lines(t, tasks=tasks)
    lj = o.join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return lj.select(*base, F.coalesce("category", F.lit("NONE")).alias("product_category"), *rest,
                     F.coalesce("refund", F.lit(0)).alias("refund_flag"),
                     F.coalesce("discounted", F.lit(0)).alias("discount_flag"))


def behavior_events(t: Tables, props: bool = False) -> DataFrame:
    """`props`: with the event's JSON attributes as one more column."""
    e = t.events
    return e.select(*["props"] * props,
        "event_id", F.col("user_id").alias("customer_id"),
        F.when(F.col("event_type") == "view", "page_view")
         .when(F.col("event_type") == "click", "add_to_cart")
         .otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.col("ts").alias("event_timestamp"), "value")


def sessions(t: Tables) -> DataFrame:
    """Analytics sessions (customer, session_id, device_code): a session is a
    customer's events of one day; its device is a stand-in coded 1..4
    (Desktop, Mobile iOS, Mobile Android, Tablet) from the `props.k` of the
    session's first event (ties by event_id). One partial aggregation keyed
    on (customer, day)."""
    e = t.events
    k = F.get_json_object("props", "$.k").cast("bigint")
    first = F.min_by(k, F.struct("ts", "event_id"))
    return (e.groupBy(F.col("user_id").alias("customer_id"), F.to_date("ts").alias("day"))
            .agg((1 + first % 4).alias("device_code"))
            .select("customer_id", F.concat(F.col("customer_id").cast("string"), F.lit("-"),
                                            F.col("day").cast("string")).alias("session_id"), "device_code"))


def support_tickets(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type") == "error")
    return e.select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("customer_id"),
                    F.col("ts").alias("created_date"), F.col("value").alias("resolution_hours"),
                    ((F.col("event_id") % 101).cast("double") / 100).alias("sentiment_score"))


def reviews(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type") == "signup")
    return e.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("customer_id"),
                    F.col("ts").alias("created_date"),
                    (1 + F.col("event_id") % 5).cast("double").alias("rating"),
                    ((F.col("event_id") % 101).cast("double") / 100).alias("sentiment_score"))


def predictions(t: Tables) -> DataFrame:
    """Scores of customers active in 2000; churn = no order in January 2001.
    Both flags come from one scan of the orders in [2000-01-01, 2001-01-31)
    aggregated per customer (partial aggregation), then one join with the
    customer table."""
    return predictions_at(t, "2001-01-01 00:00:00", lookback="1 YEAR")


# ---------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle (FIXTURES.md §3).
# These texts are the fixture definitions and must stay equal
# to the builders above.
VIEW_SQL = {
    "customers": """
SELECT c.c_custkey AS customer_id, c.c_name AS email,
  CASE n.n_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'DE' WHEN 3 THEN 'IN' ELSE 'BR' END AS country,
  r.r_name AS region,
  MIN(o.o_orderdate) AS signup_date,
  CASE WHEN c.c_acctbal < 0 THEN 'closed' ELSE 'active' END AS account_status,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'VIP' WHEN 'BUILDING' THEN 'Regular' WHEN 'MACHINERY' THEN 'Regular' ELSE 'New' END AS customer_segment,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Web' WHEN 1 THEN 'Mobile' ELSE 'App' END AS device_type,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Organic' WHEN 1 THEN 'Paid' WHEN 2 THEN 'Referral' ELSE NULL END AS signup_source,
  CASE WHEN c.c_acctbal < 0 THEN MAX(o.o_orderdate) END AS deleted_at
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name, n.n_nationkey, r.r_name, c.c_acctbal, c.c_mktsegment""",
    "transactions": """
SELECT o.o_orderkey AS transaction_id, o.o_custkey AS customer_id, o.o_orderdate AS order_date,
  CAST(o.o_totalprice AS DECIMAL(18,2)) AS order_amount,
  COALESCE(l.category, 'NONE') AS product_category,
  o.o_orderpriority AS payment_method, o.o_orderstatus AS shipping_status,
  COALESCE(l.refund, 0) AS refund_flag,
  COALESCE(l.discounted, 0) AS discount_flag
FROM orders o LEFT JOIN (
  SELECT l_orderkey, MIN(p_type) AS category,
    MAX(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS refund,
    MIN(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END) AS discounted
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "behavior_events": """
SELECT event_id, user_id AS customer_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type,
  CONCAT(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS session_id,
  ts AS event_timestamp, value
FROM events""",
    "sessions": """
SELECT customer_id, CONCAT(CAST(customer_id AS VARCHAR(20)), '-', CAST(day AS VARCHAR(20))) AS session_id,
  1 + k % 4 AS device_code
FROM (SELECT user_id AS customer_id, CAST(ts AS DATE) AS day,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn
      FROM events) WHERE rn = 1""",
    "support_tickets": """
SELECT event_id AS ticket_id, user_id AS customer_id, ts AS created_date, value AS resolution_hours, CAST(event_id % 101 AS DOUBLE) / 100 AS sentiment_score FROM events WHERE event_type = 'error'""",
    "reviews": """
SELECT event_id AS review_id, user_id AS customer_id, ts AS created_date, CAST(1 + event_id % 5 AS DOUBLE) AS rating, CAST(event_id % 101 AS DOUBLE) / 100 AS sentiment_score FROM events WHERE event_type = 'signup'""",
    "predictions": """
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment,
  CAST((c.c_custkey * 37) % 101 AS DOUBLE) / 100 AS churn_probability,
  CASE WHEN f.o_custkey IS NULL THEN 1 ELSE 0 END AS actual_churn
FROM customer c
JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01') a ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate < TIMESTAMP '2001-01-31') f ON f.o_custkey = c.c_custkey""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix `sql` with the named views as CTEs (DuckDB oracle text)."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def predictions_at(t: Tables, cut: str, lookback: str = "1 YEAR") -> DataFrame:
    """The `predictions` view for another observation cut: customers active in
    the year before `cut`, churn = no order in [cut, cut + 30 days). One
    range scan of orders, one per-customer aggregation of both flags."""
    c0 = F.lit(cut).cast("timestamp_ntz")
    d = F.col("o_orderdate")
    o = t.orders.select("o_custkey", "o_orderdate") \
        .filter((d >= c0 - F.expr(f"INTERVAL {lookback}")) & (d < c0 + F.expr("INTERVAL 30 DAYS")))
    flags = o.groupBy("o_custkey").agg(F.max(d < c0).alias("_active"), F.max(d >= c0).alias("_back")) \
        .filter(F.col("_active"))
    c = t.customer.join(flags, F.col("o_custkey") == F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
                    (((F.col("c_custkey") * 37) % 101).cast("double") / 100).alias("churn_probability"),
                    F.when(F.col("_back"), 0).otherwise(1).alias("actual_churn"))


def predictions_at_sql(cut: str) -> str:
    return f"""
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment,
  CAST((c.c_custkey * 37) % 101 AS DOUBLE) / 100 AS churn_probability,
  CASE WHEN f.o_custkey IS NULL THEN 1 ELSE 0 END AS actual_churn
FROM customer c
JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{cut}' - INTERVAL 1 YEAR AND o_orderdate < TIMESTAMP '{cut}') a ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{cut}' AND o_orderdate < TIMESTAMP '{cut}' + INTERVAL 30 DAY) f ON f.o_custkey = c.c_custkey"""


def predictions_multi(t: Tables, cuts) -> DataFrame:
    """`predictions_at` for several cuts from ONE pass over orders: a single
    per-customer aggregate of (active, future) flags for every cut, exploded
    to one row per (cut, active customer). Columns: ts, customer_id, segment,
    churn_probability, actual_churn."""
    o = t.orders.select("o_custkey", "o_orderdate")
    d = F.col("o_orderdate")
    aggs = []
    for i, c in enumerate(cuts):
        c0 = F.lit(c).cast("timestamp_ntz")
        aggs += [F.max((d >= c0 - F.expr("INTERVAL 1 YEAR")) & (d < c0)).alias(f"a{i}"),
                 F.max((d >= c0) & (d < c0 + F.expr("INTERVAL 30 DAYS"))).alias(f"f{i}")]
    g = o.groupBy("o_custkey").agg(*aggs)
    per_cut = g.select("o_custkey", F.explode(F.array(*[
        F.struct(F.lit(c).alias("ts"), F.col(f"a{i}").alias("active"), F.col(f"f{i}").alias("future"))
        for i, c in enumerate(cuts)])).alias("x")).filter(F.col("x.active"))
    j = per_cut.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.select(F.col("x.ts").alias("ts"), F.col("c_custkey").alias("customer_id"),
                    F.col("c_mktsegment").alias("segment"),
                    (((F.col("c_custkey") * 37) % 101).cast("double") / 100).alias("churn_probability"),
                    F.when(F.col("x.future"), 0).otherwise(1).alias("actual_churn"))
