"""DuckDB oracle CTEs: fixture adapters, merge, Pareto selection, features.

These restate each operator's definition in plain SQL, independently of
the Spark code (for example the spread uses the row-by-row ``lag`` form,
while the Spark operator uses the closed form ``greatest(0, l - f - n)``).
"""

from __future__ import annotations

from .sqlkit import CteBook

BOOK = CteBook()
add = BOOK.add

# ---------------------------------------------------------------- fixtures --
add("orders_t", """
SELECT o_orderkey AS order_id, o_custkey AS user_id, 'prior' AS eval_set,
       CAST(row_number() OVER w AS INTEGER) AS order_number,
       CAST(dayofweek(CAST(o_orderdate AS DATE)) AS INTEGER) AS order_dow,
       CAST(CAST(o_orderdate AS DATE) - CAST(lag(o_orderdate) OVER w AS DATE) AS DOUBLE)
           AS days_since_prior_order
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""")

# fixture A: product = part name
add("names_t", """
SELECT min(p_partkey) AS product_id, p_name AS product_name,
       string_split(p_name, ' ')[2] AS aisle, string_split(p_name, ' ')[1] AS department
FROM part GROUP BY p_name""")
add("aisles_t", """
SELECT CAST(row_number() OVER (ORDER BY aisle) AS BIGINT) AS aisle_id, aisle
FROM (SELECT DISTINCT aisle FROM names_t WHERE aisle IS NOT NULL)""")
add("departments_t", """
SELECT CAST(row_number() OVER (ORDER BY department) AS BIGINT) AS department_id, department
FROM (SELECT DISTINCT department FROM names_t WHERE department IS NOT NULL)""")
add("products_t", """
SELECT n.product_id, n.product_name, a.aisle_id, d.department_id
FROM names_t n LEFT JOIN aisles_t a ON n.aisle = a.aisle
LEFT JOIN departments_t d ON n.department = d.department""")
add("partmap_t", """
SELECT p.p_partkey, n.product_id FROM part p JOIN names_t n ON p.p_name = n.product_name""")
add("lines_t", """
SELECT order_id, product_id,
       row_number() OVER (PARTITION BY order_id ORDER BY position, product_id) AS add_to_cart_order
FROM (SELECT l.l_orderkey AS order_id, m.product_id, min(l.l_linenumber) AS position
      FROM lineitem l JOIN partmap_t m ON l.l_partkey = m.p_partkey GROUP BY 1, 2)""")
add("order_products_t", """
SELECT order_id, product_id, CAST(add_to_cart_order AS INTEGER) AS add_to_cart_order,
       CAST(order_number > min(order_number) OVER (PARTITION BY user_id, product_id) AS INTEGER)
           AS reordered
FROM (SELECT l.order_id, l.product_id, l.add_to_cart_order, o.user_id, o.order_number
      FROM lines_t l JOIN orders_t o ON l.order_id = o.order_id)""")
add("data_t", """
SELECT o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
       COALESCE(o.days_since_prior_order, 0) AS days_since_prior_order,
       op.product_id, op.add_to_cart_order, op.reordered,
       p.product_name, p.aisle_id, p.department_id, a.aisle, d.department
FROM orders_t o
JOIN order_products_t op ON o.order_id = op.order_id
JOIN products_t p ON op.product_id = p.product_id
JOIN aisles_t a ON p.aisle_id = a.aisle_id
JOIN departments_t d ON p.department_id = d.department_id""")
add("dim_t", """
SELECT p.product_id, p.product_name, p.aisle_id, a.aisle, p.department_id, d.department
FROM products_t p LEFT JOIN aisles_t a ON p.aisle_id = a.aisle_id
LEFT JOIN departments_t d ON p.department_id = d.department_id""")

# fixture B: product = part key, dimension only for parts with p_size > 5
add("baisles_t", """
SELECT CAST(row_number() OVER (ORDER BY aisle) AS BIGINT) AS aisle_id, aisle
FROM (SELECT DISTINCT p_brand AS aisle FROM part WHERE p_brand IS NOT NULL)""")
add("bdepartments_t", """
SELECT CAST(row_number() OVER (ORDER BY department) AS BIGINT) AS department_id, department
FROM (SELECT DISTINCT p_type AS department FROM part WHERE p_type IS NOT NULL)""")
add("bproducts_t", """
SELECT p.p_partkey AS product_id, p.p_name AS product_name, a.aisle_id, d.department_id
FROM part p LEFT JOIN baisles_t a ON p.p_brand = a.aisle
LEFT JOIN bdepartments_t d ON p.p_type = d.department
WHERE p.p_size > 5""")
add("blines_t", """
SELECT order_id, product_id,
       row_number() OVER (PARTITION BY order_id ORDER BY position, product_id) AS add_to_cart_order
FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, min(l_linenumber) AS position
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""")
add("border_products_t", """
SELECT order_id, product_id, CAST(add_to_cart_order AS INTEGER) AS add_to_cart_order,
       CAST(order_number > min(order_number) OVER (PARTITION BY user_id, product_id) AS INTEGER)
           AS reordered
FROM (SELECT l.order_id, l.product_id, l.add_to_cart_order, o.user_id, o.order_number
      FROM blines_t l JOIN orders_t o ON l.order_id = o.order_id)""")
add("bdata_t", """
SELECT o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
       COALESCE(o.days_since_prior_order, 0) AS days_since_prior_order,
       op.product_id, op.add_to_cart_order, op.reordered,
       p.product_name, p.aisle_id, p.department_id, a.aisle, d.department
FROM orders_t o
JOIN border_products_t op ON o.order_id = op.order_id
JOIN bproducts_t p ON op.product_id = p.product_id
JOIN baisles_t a ON p.aisle_id = a.aisle_id
JOIN bdepartments_t d ON p.department_id = d.department_id""")
add("bdim_t", """
SELECT p.product_id, p.product_name, p.aisle_id, a.aisle, p.department_id, d.department
FROM bproducts_t p LEFT JOIN baisles_t a ON p.aisle_id = a.aisle_id
LEFT JOIN bdepartments_t d ON p.department_id = d.department_id""")

# ------------------------------------------------------------------ pareto --
add("counts_t", """
SELECT product_id, count(*) AS observation_count FROM data_t GROUP BY product_id""")
add("shares_t", """
SELECT product_id, observation_count,
       CAST(sum(observation_count) OVER (ORDER BY observation_count DESC, product_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
       / CAST(sum(observation_count) OVER () AS DOUBLE) * CAST(100 AS DOUBLE) AS cumulative_percentage
FROM counts_t""")
add("cutoff_t", "SELECT * FROM shares_t WHERE cumulative_percentage <= CAST(80 AS DOUBLE)")
add("top6_t", """
SELECT product_id, observation_count FROM counts_t
ORDER BY observation_count DESC, product_id LIMIT 6""")
add("pl_t", """
SELECT * FROM data_t
WHERE product_id IN (SELECT product_id FROM cutoff_t)
  AND product_id NOT IN (SELECT product_id FROM top6_t)""")

# ---------------------------------------------------------------- features --
add("user_all_t", """
SELECT user_id, avg(days_since_prior_order) AS avg_days_since_prior_order,
       avg(reordered) AS u_reordered_ratio, CAST(max(order_number) AS INTEGER) AS u_total_orders
FROM pl_t GROUP BY user_id""")
add("osize_t", "SELECT user_id, order_id, count(product_id) AS size FROM pl_t GROUP BY 1, 2")
add("osavg_t", "SELECT user_id, avg(size) AS order_size_avg FROM osize_t GROUP BY 1")
add("user_t", """
SELECT u.user_id, u.avg_days_since_prior_order, u.u_reordered_ratio, u.u_total_orders,
       s.order_size_avg
FROM user_all_t u JOIN osavg_t s ON u.user_id = s.user_id
WHERE u.u_total_orders >= 3""")
add("prd_t", """
SELECT product_id, count(order_id) AS p_total_purchases, avg(reordered) AS p_reorder_ratio,
       avg(add_to_cart_order) AS mean_add_to_cart_order
FROM pl_t GROUP BY product_id""")
add("gaps_t", """
SELECT *, CAST(COALESCE(order_number - lag(order_number) OVER
              (PARTITION BY user_id, product_id ORDER BY order_number, order_id), 0) - 1 AS DOUBLE)
          AS order_diff
FROM pl_t""")
add("spread_t", """
SELECT user_id, product_id, greatest(0, sum(order_diff)) AS spread,
       count(order_id) AS n, min(order_number) AS first_order_number
FROM gaps_t GROUP BY user_id, product_id""")
add("tot_t", "SELECT user_id, max(order_number) AS total_orders FROM pl_t GROUP BY user_id")
add("sticky_t", """
SELECT s.user_id, s.product_id, s.n,
       CAST(0.5 AS DOUBLE) * (CAST(s.n AS DOUBLE) / CAST(t.total_orders AS DOUBLE))
       + CAST(0.5 AS DOUBLE) * (CAST(s.n AS DOUBLE)
           / CAST((t.total_orders - s.first_order_number + 1) + s.spread AS DOUBLE)) AS sticky
FROM spread_t s JOIN tot_t t ON s.user_id = t.user_id""")
add("pairf_t", """
SELECT s.user_id, s.product_id, s.n AS uxp_total_bought, s.sticky,
       u.avg_days_since_prior_order, u.u_reordered_ratio, u.u_total_orders, u.order_size_avg,
       p.p_total_purchases, p.p_reorder_ratio, p.mean_add_to_cart_order
FROM sticky_t s LEFT JOIN user_t u ON s.user_id = u.user_id
LEFT JOIN prd_t p ON s.product_id = p.product_id""")
add("feature_t", """
SELECT f.user_id, d.product_name, f.uxp_total_bought, f.sticky,
       f.avg_days_since_prior_order, f.u_reordered_ratio, f.u_total_orders, f.order_size_avg,
       f.p_total_purchases, f.p_reorder_ratio, f.mean_add_to_cart_order, d.aisle, d.department
FROM pairf_t f LEFT JOIN dim_t d ON f.product_id = d.product_id""")

# ------------------------------------------------------- matrix / profiles --
add("mx_t", "SELECT user_id, product_name, sticky AS value FROM feature_t")
add("lab_t", "SELECT DISTINCT user_id, CAST(user_id % 3 AS INTEGER) AS cluster FROM mx_t")
add("csize_t", "SELECT cluster, count(*) AS users FROM lab_t GROUP BY cluster")
add("urows_t", """
SELECT user_id, max(avg_days_since_prior_order) AS avg_days_since_prior_order,
       max(u_reordered_ratio) AS u_reordered_ratio, max(u_total_orders) AS u_total_orders,
       max(order_size_avg) AS order_size_avg
FROM feature_t GROUP BY user_id""")
add("attrs_t", """
SELECT product_name, arg_max(aisle, product_id) AS aisle, arg_max(department, product_id) AS department
FROM dim_t WHERE product_name IS NOT NULL GROUP BY product_name""")
add("lk_t", """
SELECT n.product_name, COALESCE(a.aisle, 'Unknown') AS aisle,
       COALESCE(a.department, 'Unknown') AS department
FROM (SELECT DISTINCT product_name FROM mx_t) n LEFT JOIN attrs_t a ON n.product_name = a.product_name""")
add("uam_t", """
SELECT m.user_id, k.aisle, sum(m.value) AS value
FROM mx_t m JOIN lk_t k ON m.product_name = k.product_name GROUP BY 1, 2""")
add("udm_t", """
SELECT m.user_id, k.department, sum(m.value) AS value
FROM mx_t m JOIN lk_t k ON m.product_name = k.product_name GROUP BY 1, 2""")
for _cte, _src, _item in [("segpm_t", "mx_t", "product_name"), ("segam_t", "uam_t", "aisle"),
                          ("segdm_t", "udm_t", "department")]:
    add(_cte, f"""
SELECT l.cluster, m.{_item}, sum(m.value) / c.users AS mean
FROM {_src} m JOIN lab_t l ON m.user_id = l.user_id JOIN csize_t c ON l.cluster = c.cluster
GROUP BY l.cluster, m.{_item}, c.users""")
for _cte, _src, _means, _item in [("rkp_t", "mx_t", "segpm_t", "product_name"),
                                  ("rka_t", "uam_t", "segam_t", "aisle"),
                                  ("rkd_t", "udm_t", "segdm_t", "department")]:
    add(_cte, f"""
SELECT cluster, item, mean,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, item ASC) AS INTEGER) AS r_top,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY mean ASC, item DESC) AS INTEGER) AS r_bottom
FROM (SELECT c.cluster, u.item, COALESCE(s.mean, CAST(0 AS DOUBLE)) AS mean
      FROM (SELECT DISTINCT cluster FROM lab_t) c
      CROSS JOIN (SELECT DISTINCT {_item} AS item FROM {_src}) u
      LEFT JOIN {_means} s ON s.cluster = c.cluster AND s.{_item} = u.item)""")

# fixture B lookups
add("battrs_t", """
SELECT product_name, arg_max(aisle, product_id) AS aisle, arg_max(department, product_id) AS department
FROM bdim_t WHERE product_name IS NOT NULL GROUP BY product_name""")

# ------------------------------------------------------------------ latent --
add("lat_t", "SELECT vec_id AS user_id, CAST(embedding AS DOUBLE[]) AS latent, label FROM embeddings")
add("lv0_t", """
SELECT user_id, label, CAST(unnest(generate_series(0, len(latent) - 1)) AS INTEGER) AS dim,
       unnest(latent) AS value
FROM lat_t""")
add("latv_t", """
SELECT 'embedding' AS model, user_id, dim, value FROM lv0_t
UNION ALL
SELECT 'embedding_sigmoid' AS model, user_id, dim,
       CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-value)) AS value FROM lv0_t""")
add("mact_t", "SELECT model, dim, avg(value) AS mean_activation FROM latv_t GROUP BY 1, 2")
add("cent_t", """
SELECT label AS cluster, dim, avg(value) AS c FROM lv0_t WHERE label IN (0, 1, 2) GROUP BY 1, 2""")
add("cent2_t", """
SELECT CASE label WHEN 3 THEN 2 ELSE label END AS cluster, dim, avg(value) AS c
FROM lv0_t WHERE label IN (0, 1, 3) GROUP BY 1, 2""")
add("d2_t", """
SELECT v.user_id, c.cluster, sum((v.value - c.c) * (v.value - c.c)) AS d2
FROM lv0_t v JOIN cent_t c ON v.dim = c.dim GROUP BY 1, 2""")
add("d22_t", """
SELECT v.user_id, c.cluster, sum((v.value - c.c) * (v.value - c.c)) AS d2
FROM lv0_t v JOIN cent2_t c ON v.dim = c.dim GROUP BY 1, 2""")
add("q_t", """
SELECT user_id, CAST(cluster AS INTEGER) AS cluster, k / sum(k) OVER (PARTITION BY user_id) AS q
FROM (SELECT user_id, cluster,
             power(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + d2 / CAST(1 AS DOUBLE)), CAST(1 AS DOUBLE)) AS k
      FROM d2_t)""")
add("f_t", "SELECT cluster, sum(q) AS f FROM q_t GROUP BY 1")
add("p_t", """
SELECT user_id, cluster, q, w / sum(w) OVER (PARTITION BY user_id) AS p
FROM (SELECT q.user_id, q.cluster, q.q, q.q * q.q / f.f AS w FROM q_t q JOIN f_t f ON q.cluster = f.cluster)""")

# basket vectors and the fixture encoder
add("idx_t", """
SELECT product_name, CAST(row_number() OVER (ORDER BY product_name) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT product_name FROM feature_t WHERE product_name IS NOT NULL)""")
add("tri_t", """
SELECT m.user_id, i.idx, m.value FROM mx_t m JOIN idx_t i ON m.product_name = i.product_name""")


def _w(layer: int, i: str, j: str) -> str:
    return (f"(CAST((((31 * {i} + 17 * {j} + 7 * {layer}) % 101) - 50) AS DOUBLE) "
            f"/ CAST(500 AS DOUBLE))")


def _b(j: str) -> str:
    return f"(CAST((({j} % 7) - 3) AS DOUBLE) / CAST(50 AS DOUBLE))"


def _sig(x: str) -> str:
    return f"(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-({x}))))"


add("h1_t", f"""
SELECT t.user_id, r.j, {_sig(f"sum(t.value * {_w(0, 't.idx', 'r.j')}) + {_b('r.j')}")} AS a
FROM tri_t t CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(8)) r GROUP BY t.user_id, r.j""")
add("h2_t", f"""
SELECT h.user_id, r.k, {_sig(f"sum(h.a * {_w(1, 'h.j', 'r.k')}) + {_b('r.k')}")} AS a
FROM h1_t h CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(4)) r GROUP BY h.user_id, r.k""")
add("out_t", f"""
SELECT h.user_id, r.idx AS j, {_sig(f"sum(h.a * {_w(2, 'h.k', 'r.idx')}) + {_b('r.idx')}")} AS y
FROM h2_t h CROSS JOIN idx_t r GROUP BY h.user_id, r.idx""")
add("umse_t", """
SELECT o.user_id, avg((o.y - COALESCE(t.value, 0)) * (o.y - COALESCE(t.value, 0))) AS mse
FROM out_t o LEFT JOIN tri_t t ON o.user_id = t.user_id AND o.j = t.idx GROUP BY o.user_id""")
