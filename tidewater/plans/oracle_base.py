"""DuckDB text of the shared fixture views, prefixed to every oracle query.

The oracle joins all dimensions (the full view); the Spark side joins only
the ones a job needs.  Both agree because every foreign key resolves and
dimension keys are unique.
"""

ORDER_LINES_CTE = """
ol_base AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_partkey AS product_id,
         l.l_suppkey AS supplier_id, l.l_quantity AS quantity, l.l_discount AS discount_rate,
         l.l_extendedprice * (1 - l.l_discount) AS order_value, l.l_tax AS tax,
         l.l_returnflag AS order_type, l.l_shipdate AS shipping_date,
         CAST(50 + (((l.l_orderkey * 31 + l.l_linenumber * 17) % 750) + 750) % 750 AS BIGINT) AS inventory,
         CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_id,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
              WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
         CAST((((date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) % 7) + 7) % 7 AS INTEGER)
           AS actual_days,
         p.p_name AS product_name, p.p_type AS category, p.p_brand AS department,
         s.s_name AS supplier, s.s_nationkey AS supplier_nation,
         c.c_mktsegment AS customer_segment, c.c_nationkey AS customer_nation,
         n.n_name AS country, n.n_name AS order_region, n.n_name AS city, r.r_name AS market
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
ol_sched AS (
  SELECT *, CAST(CASE shipping_mode WHEN 'Same Day' THEN 0 WHEN 'First Class' THEN 1
                 WHEN 'Second Class' THEN 2 ELSE 4 END AS INTEGER) AS scheduled_days
  FROM ol_base
),
order_lines AS (
  SELECT *, CAST(CASE WHEN actual_days > scheduled_days THEN 1 ELSE 0 END AS INTEGER) AS late_risk,
         scheduled_days AS days_to_delivery
  FROM ol_sched
)"""


def with_order_lines(*ctes: str) -> str:
    """``WITH <order_lines>, <ctes...>`` — the caller appends the final SELECT."""
    parts = [ORDER_LINES_CTE.strip()] + [c.strip() for c in ctes if c.strip()]
    return "WITH " + ",\n".join(parts) + "\n"
