"""Analyses over the star schema."""

STAR = """
WITH s_organizations AS (
  SELECT s_suppkey AS org_id, s_name AS org_name, r_name AS industry, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
s_products AS (
  SELECT p_partkey AS product_id, p_partkey % (SELECT count(*) FROM supplier) AS org_id,
         p_name AS product_name, p_type AS category, p_retailprice AS price,
         p_size AS stock_quantity
  FROM part
),
s_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country,
         c_acctbal AS account_balance, c_mktsegment AS customer_segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
s_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, org_id,
         CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS total_amount,
         CAST(coalesce(n, 0) AS INTEGER) AS num_items, o_orderstatus AS order_status
  FROM orders LEFT JOIN (
    SELECT l_orderkey, min(l_suppkey) AS org_id, count(*) AS n FROM lineitem GROUP BY l_orderkey
  ) ON o_orderkey = l_orderkey
),
s_order_items AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS TIMESTAMP))) AS order_item_id,
         l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_extendedprice AS subtotal
  FROM lineitem
)
"""

ORACLE = {
    "orders_with_customers": STAR
    + """SELECT o.customer_id, order_id, org_id, order_date, total_amount, num_items, order_status,
                customer_name, country, account_balance, customer_segment
         FROM s_orders o JOIN s_customers c ON o.customer_id = c.customer_id""",
    "order_items_with_products": STAR
    + """SELECT i.product_id, order_item_id, order_id, quantity, unit_price, subtotal, org_id,
                product_name, category, price, stock_quantity
         FROM s_order_items i JOIN s_products p ON i.product_id = p.product_id""",
    "order_chain": STAR
    + """SELECT g.org_id, o.customer_id, order_id, order_date, total_amount, num_items, order_status,
                customer_name, c.country AS customer_country, account_balance, customer_segment, org_name, industry,
                g.country AS org_country
         FROM s_orders o JOIN s_customers c ON o.customer_id = c.customer_id
              JOIN s_organizations g ON o.org_id = g.org_id""",
    "order_customer_list": STAR
    + """SELECT order_id, customer_name, total_amount
         FROM s_orders o JOIN s_customers c ON o.customer_id = c.customer_id
         ORDER BY order_id LIMIT 20""",
    "cross_source_order_counts": STAR
    + """SELECT c.customer_id, customer_name, count(order_id) AS total_orders
         FROM s_customers c JOIN s_orders o ON o.customer_id = c.customer_id
         GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""",
    "top_products": STAR
    + """SELECT product_id, count(*) AS count FROM s_order_items
         GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 5""",
    "customer_spending": STAR
    + """SELECT customer_id,
                CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
                count(order_id) AS num_orders
         FROM s_orders GROUP BY customer_id
         ORDER BY sum(CAST(total_amount AS DECIMAL(18,2))) DESC, customer_id LIMIT 5""",
    "organization_performance": STAR
    + """SELECT o.org_id, total_revenue, total_orders, org_name, industry, country
         FROM (SELECT org_id, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
                      count(order_id) AS total_orders
               FROM s_orders GROUP BY org_id) o JOIN s_organizations g ON o.org_id = g.org_id""",
    "product_performance": STAR
    + """SELECT p.product_id, total_revenue, total_quantity_sold, org_id, product_name, category,
                price, stock_quantity
         FROM (SELECT product_id, CAST(sum(CAST(subtotal AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
                      CAST(sum(quantity) AS BIGINT) AS total_quantity_sold
               FROM s_order_items GROUP BY product_id) i JOIN s_products p ON i.product_id = p.product_id""",
    "category_sales": STAR
    + """SELECT category, CAST(sum(CAST(subtotal AS DECIMAL(18,2))) AS DOUBLE) AS category_revenue,
                CAST(sum(quantity) AS BIGINT) AS category_quantity
         FROM s_order_items i JOIN s_products p ON i.product_id = p.product_id GROUP BY category""",
    "dataset_summary": STAR
    + """SELECT (SELECT count(*) FROM s_organizations) AS organizations_count,
                (SELECT count(*) FROM s_products) AS products_count,
                (SELECT count(*) FROM s_customers) AS customers_count,
                count(*) AS orders_count,
                (SELECT count(*) FROM s_order_items) AS order_items_count,
                CAST(coalesce(sum(CAST(total_amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_order_value,
                CASE WHEN count(*) = 0 THEN 0.0
                     ELSE CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(*)
                END AS avg_order_value
         FROM s_orders""",
    "table_row_counts": STAR
    + """SELECT 'organizations' AS table_name, count(*) AS row_count FROM s_organizations
         UNION ALL SELECT 'products', count(*) FROM s_products
         UNION ALL SELECT 'customers', count(*) FROM s_customers
         UNION ALL SELECT 'orders', count(*) FROM s_orders
         UNION ALL SELECT 'order_items', count(*) FROM s_order_items""",
    "orders_by_status": STAR + "SELECT * FROM s_orders WHERE order_status = 'F'",
    "customers_preview": STAR + "SELECT * FROM s_customers ORDER BY customer_id LIMIT 10",
}
