"""DuckDB oracle SQL for the registered queries (same names, same columns).

Each entry is ``(select, doubles)``: the final SELECT over the CTEs of
``oracle_base`` and the double columns that are rounded to 6 decimals, as
the Spark side rounds every double column.
"""

from __future__ import annotations

from .oracle_base import BOOK, _b, _w

_ENTRIES: dict[str, tuple[str, tuple[str, ...]]] = {}


def oracle(name: str, select: str, doubles: tuple[str, ...] = ()) -> None:
    if name in _ENTRIES:
        raise KeyError(name)
    _ENTRIES[name] = (select, doubles)


def render(name: str) -> str:
    select, doubles = _ENTRIES[name]
    body = BOOK.query(select)
    if not doubles:
        return body
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    repl = ", ".join(f"round({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n)"


def all_sql() -> dict[str, str]:
    return {name: render(name) for name in _ENTRIES}


DAYS = ("days_since_prior_order",)
LINE_COLS = """order_id, user_id, eval_set, order_number, order_dow, days_since_prior_order,
       product_id, add_to_cart_order, reordered, product_name, aisle_id, department_id, aisle, department"""
USER_DOUBLES = ("avg_days_since_prior_order", "u_reordered_ratio", "order_size_avg")
PRODUCT_DOUBLES = ("p_reorder_ratio", "mean_add_to_cart_order")

# ------------------------------------------------------------------ sources --
oracle("basket_lines", "SELECT * FROM order_products_t")
oracle("basket_orders", "SELECT * FROM orders_t", DAYS)
oracle("basket_products", "SELECT * FROM dim_t")

# -------------------------------------------------------------------- merge --
oracle("orders_filled", """
SELECT order_id, user_id, eval_set, order_number, order_dow,
       COALESCE(days_since_prior_order, 0) AS days_since_prior_order FROM orders_t""", DAYS)
oracle("merge_lines", """
SELECT o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
       COALESCE(o.days_since_prior_order, 0) AS days_since_prior_order,
       op.product_id, op.add_to_cart_order, op.reordered
FROM orders_t o JOIN order_products_t op ON o.order_id = op.order_id""", DAYS)
oracle("merge_products", """
SELECT op.product_id, o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
       COALESCE(o.days_since_prior_order, 0) AS days_since_prior_order,
       op.add_to_cart_order, op.reordered, p.product_name, p.aisle_id, p.department_id
FROM orders_t o JOIN order_products_t op ON o.order_id = op.order_id
JOIN products_t p ON op.product_id = p.product_id""", DAYS)
oracle("merge_full", f"SELECT {LINE_COLS} FROM data_t", DAYS)

# ---------------------------------------------------------------- selection --
oracle("product_counts", "SELECT * FROM counts_t")
oracle("cumulative_share", "SELECT * FROM shares_t", ("cumulative_percentage",))
oracle("observation_share", """
SELECT product_id, observation_count,
       CAST(observation_count AS DOUBLE) / CAST(sum(observation_count) OVER () AS DOUBLE)
       * CAST(100 AS DOUBLE) AS observation_percentage
FROM counts_t""", ("observation_percentage",))
oracle("pareto_cutoff", "SELECT * FROM cutoff_t", ("cumulative_percentage",))
oracle("pareto_target", "SELECT count(*) AS target FROM cutoff_t")
oracle("top6_products", """
SELECT t.product_id, t.observation_count, p.product_name, p.aisle_id, p.department_id
FROM top6_t t LEFT JOIN products_t p ON t.product_id = p.product_id""")
oracle("counts_with_names", """
SELECT c.product_id, c.observation_count,
       CAST(c.observation_count AS DOUBLE) / CAST(sum(c.observation_count) OVER () AS DOUBLE)
       * CAST(100 AS DOUBLE) AS observation_percentage,
       p.product_name, p.aisle_id, p.department_id
FROM counts_t c LEFT JOIN products_t p ON c.product_id = p.product_id""",
       ("observation_percentage",))
oracle("lines_in_head_products", f"""
SELECT {LINE_COLS} FROM data_t WHERE product_id IN (SELECT product_id FROM cutoff_t)""", DAYS)
oracle("lines_in_head_products_bloom", f"""
SELECT {LINE_COLS} FROM data_t WHERE product_id IN (SELECT product_id FROM cutoff_t)""", DAYS)
oracle("lines_without_top6", f"""
SELECT {LINE_COLS} FROM data_t WHERE product_id NOT IN (SELECT product_id FROM top6_t)""", DAYS)
oracle("pareto_lines", f"SELECT {LINE_COLS} FROM pl_t", DAYS)

# ----------------------------------------------------------------- features --
oracle("sticky", "SELECT user_id, product_id, sticky FROM sticky_t", ("sticky",))
oracle("user_features", "SELECT * FROM user_t", USER_DOUBLES)
oracle("product_features", "SELECT * FROM prd_t", PRODUCT_DOUBLES)
oracle("feature_table", "SELECT * FROM feature_t", ("sticky",) + USER_DOUBLES + PRODUCT_DOUBLES)


# ------------------------------------------------------------ batch two --
FEATURE_DOUBLES = ("sticky",) + USER_DOUBLES + PRODUCT_DOUBLES


def _hash(seed: int, col: str = "user_id") -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT)"


oracle("uxp_features", "SELECT user_id, product_id, n AS uxp_total_bought, sticky FROM sticky_t", ("sticky",))
oracle("pair_features", "SELECT * FROM pairf_t", FEATURE_DOUBLES)
oracle("order_span", """
SELECT f.user_id, t.total_orders, f.product_id, f.first_order_number,
       t.total_orders - f.first_order_number + 1 AS Order_Range_D
FROM (SELECT user_id, product_id, min(order_number) AS first_order_number FROM pl_t GROUP BY 1, 2) f
LEFT JOIN tot_t t ON f.user_id = t.user_id""")
oracle("user_avg_days", """
SELECT user_id, avg(days_since_prior_order) AS avg_days_since_prior_order FROM pl_t GROUP BY 1""",
       ("avg_days_since_prior_order",))
oracle("user_total_orders", """
SELECT user_id, CAST(max(order_number) AS INTEGER) AS u_total_orders FROM pl_t GROUP BY 1""")
oracle("users_min_orders", """
SELECT user_id, CAST(max(order_number) AS INTEGER) AS u_total_orders FROM pl_t GROUP BY 1
HAVING max(order_number) >= 3""")
oracle("user_reorder_ratio", "SELECT user_id, avg(reordered) AS u_reordered_ratio FROM pl_t GROUP BY 1",
       ("u_reordered_ratio",))
oracle("order_size", "SELECT * FROM osize_t")
oracle("order_size_avg", "SELECT * FROM osavg_t", ("order_size_avg",))
oracle("product_purchases", "SELECT product_id, count(order_id) AS p_total_purchases FROM pl_t GROUP BY 1")
oracle("product_reorder_ratio", "SELECT product_id, avg(reordered) AS p_reorder_ratio FROM pl_t GROUP BY 1",
       ("p_reorder_ratio",))
oracle("product_cart_position", """
SELECT product_id, avg(add_to_cart_order) AS mean_add_to_cart_order FROM pl_t GROUP BY 1""",
       ("mean_add_to_cart_order",))
oracle("purchase_range", """
SELECT * FROM prd_t WHERE p_total_purchases BETWEEN 0 AND 1000 AND p_reorder_ratio BETWEEN 0 AND 1""",
       PRODUCT_DOUBLES)
oracle("axis_windows", """
SELECT p.*, w.k AS axis_window FROM prd_t p
JOIN (VALUES (1, 10000, 0.75), (2, 1000, 0.75), (3, 250, 0.75), (4, 10000, 0.0)) w(k, top, low)
  ON p.p_total_purchases BETWEEN 0 AND w.top AND p.p_reorder_ratio BETWEEN w.low AND 1""", PRODUCT_DOUBLES)
oracle("pair_times_bought", """
SELECT user_id, product_id, count(order_id) AS uxp_total_bought FROM pl_t GROUP BY 1, 2""")
oracle("pair_first_order", """
SELECT user_id, product_id, min(order_number) AS first_order_number FROM pl_t GROUP BY 1, 2""")
oracle("pair_spread", "SELECT user_id, product_id, spread FROM spread_t", ("spread",))
oracle("order_gaps", "SELECT user_id, product_id, order_id, order_number, order_diff FROM gaps_t",
       ("order_diff",))
oracle("pair_modal_dow", """
SELECT user_id, product_id, CAST(order_dow AS INTEGER) AS order_dow FROM (
  SELECT user_id, product_id, order_dow,
         row_number() OVER (PARTITION BY user_id, product_id ORDER BY c DESC, order_dow ASC) AS rn
  FROM (SELECT user_id, product_id, order_dow, count(*) AS c FROM pl_t GROUP BY 1, 2, 3))
WHERE rn = 1""")
oracle("weekday_names", """
SELECT order_id, user_id, order_number,
       CASE order_dow WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday'
            WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday'
            WHEN 6 THEN 'Saturday' END AS order_dow
FROM orders_t""")
oracle("select_features", """
SELECT user_id, product_name, sticky, avg_days_since_prior_order, u_reordered_ratio,
       u_total_orders, order_size_avg FROM feature_t""", ("sticky",) + USER_DOUBLES)
oracle("select_tail_columns", """
SELECT days_since_prior_order, product_id, add_to_cart_order, reordered, product_name,
       aisle_id, department_id, aisle, department FROM data_t""", DAYS)
oracle("drop_columns", """
SELECT order_id, user_id, eval_set, order_number, order_dow, days_since_prior_order, product_id,
       add_to_cart_order, reordered, product_name, aisle, department FROM data_t""", DAYS)
oracle("rename_columns", "SELECT user_id, product_id, sum(order_diff) AS spread FROM gaps_t GROUP BY 1, 2",
       ("spread",))
oracle("derive_columns", """
SELECT s.user_id, s.product_id, s.n AS Times_Bought_N, t.total_orders, s.first_order_number,
       t.total_orders - s.first_order_number + 1 AS Order_Range_D, s.spread, k.sticky
FROM spread_t s JOIN tot_t t ON s.user_id = t.user_id
JOIN sticky_t k ON s.user_id = k.user_id AND s.product_id = k.product_id""", ("spread", "sticky"))
oracle("category_codes", """
SELECT product_id, product_name, aisle, department,
       CAST(dense_rank() OVER (ORDER BY product_name) - 1 AS INTEGER) AS product_name_code,
       CAST(dense_rank() OVER (ORDER BY aisle) - 1 AS INTEGER) AS aisle_code,
       CAST(dense_rank() OVER (ORDER BY department) - 1 AS INTEGER) AS department_code
FROM dim_t""")
oracle("product_id_to_name", """
SELECT s.user_id, p.product_name, s.n AS uxp_total_bought, s.sticky
FROM sticky_t s LEFT JOIN products_t p ON s.product_id = p.product_id""", ("sticky",))
oracle("product_dim", "SELECT * FROM bdim_t")
oracle("product_lookup_unknown", """
SELECT n.product_name, COALESCE(a.aisle, 'Unknown') AS aisle, COALESCE(a.department, 'Unknown') AS department
FROM (SELECT DISTINCT p.p_name AS product_name
      FROM border_products_t op JOIN part p ON op.product_id = p.p_partkey) n
LEFT JOIN battrs_t a ON n.product_name = a.product_name AND length(a.product_name) % 2 = 0""")
oracle("duplicate_keys", """
SELECT user_id, product_name, count(DISTINCT product_id) AS n_items FROM bdata_t
GROUP BY 1, 2 HAVING count(DISTINCT product_id) > 1""")
oracle("sample_users", f"""
SELECT DISTINCT user_id FROM feature_t WHERE {_hash(16)} < {int(0.25 * 2 ** 32)}""")
oracle("sample_users_exact", f"""
SELECT user_id FROM (
  SELECT user_id, row_number() OVER (ORDER BY {_hash(16)}, user_id) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM feature_t WHERE user_id IS NOT NULL))
WHERE rn <= round_even(CAST(0.25 AS DOUBLE) * n, 0)""")
oracle("feature_table_large_users", "SELECT * FROM feature_t WHERE user_id IN (SELECT user_id FROM user_t)",
       ("sticky",) + USER_DOUBLES + PRODUCT_DOUBLES)
oracle("sample_user_rows", f"SELECT * FROM feature_t WHERE {_hash(16)} < {int(0.25 * 2 ** 32)}",
       FEATURE_DOUBLES)
oracle("distinct_users", "SELECT DISTINCT user_id FROM pl_t")
oracle("user_constants", "SELECT * FROM urows_t", USER_DOUBLES)
_CELLS = """
FROM {users} u CROSS JOIN (SELECT DISTINCT product_name FROM feature_t WHERE product_name IS NOT NULL) n
LEFT JOIN feature_t f ON f.user_id = u.user_id AND f.product_name = n.product_name"""
oracle("sticky_matrix", "SELECT u.user_id, n.product_name, COALESCE(f.sticky, CAST(0 AS DOUBLE)) AS value"
       + _CELLS.format(users="(SELECT DISTINCT user_id FROM feature_t)"), ("value",))
oracle("user_matrix", "SELECT u.*, n.product_name, COALESCE(f.sticky, CAST(0 AS DOUBLE)) AS value"
       + _CELLS.format(users="urows_t"), USER_DOUBLES + ("value",))
oracle("user_vectors", """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS INTEGER) AS k, idx, value
FROM tri_t""", ("value",))
oracle("holdout_split", f"""
SELECT user_id, CASE WHEN {_hash(7)} < {int(0.2 * 2 ** 32)} THEN 'validation' ELSE 'train' END AS split
FROM urows_t""")
oracle("minibatch_id", f"""
SELECT user_id, CAST({_hash(7)} % (SELECT CAST(ceil(count(*) / 256.0) AS BIGINT) FROM urows_t) AS INTEGER)
       AS batch
FROM urows_t""")

_FEATURE_TYPES = [("user_id", "bigint"), ("product_name", "string"), ("uxp_total_bought", "bigint"),
                  ("sticky", "double"), ("avg_days_since_prior_order", "double"),
                  ("u_reordered_ratio", "double"), ("u_total_orders", "int"),
                  ("order_size_avg", "double"), ("p_total_purchases", "bigint"),
                  ("p_reorder_ratio", "double"), ("mean_add_to_cart_order", "double"),
                  ("aisle", "string"), ("department", "string")]
_NUMERIC = [c for c, t in _FEATURE_TYPES if t != "string"]
_STRINGS = [c for c, t in _FEATURE_TYPES if t == "string"]
_VALUES = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_FEATURE_TYPES))
oracle("profile_info", f"""
SELECT CAST(t.position AS INTEGER) AS position, t."column", n.non_null, t.dtype
FROM (VALUES {_VALUES}) t(position, "column", dtype)
JOIN (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c, _ in _FEATURE_TYPES)} FROM feature_t)
      ON COLUMNS(*) INTO NAME "column" VALUE non_null) n ON t."column" = n."column"
""")


def _describe(src: str, cols: list[str]) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"""
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, max(value) AS max
FROM (UNPIVOT (SELECT {casts} FROM {src}) ON COLUMNS(*) INTO NAME "column" VALUE value)
GROUP BY 1"""


_DESC = ("mean", "std", "min", "q25", "q50", "q75", "max")
oracle("profile_describe", _describe("feature_t", _NUMERIC), _DESC)
oracle("product_check", _describe(
    "(SELECT a.product_id, a.p_total_purchases, b.p_reorder_ratio FROM "
    "(SELECT product_id, count(order_id) AS p_total_purchases FROM pl_t GROUP BY 1) a JOIN "
    "(SELECT product_id, avg(reordered) AS p_reorder_ratio FROM pl_t GROUP BY 1) b "
    "ON a.product_id = b.product_id)", ["product_id", "p_total_purchases", "p_reorder_ratio"]), _DESC)
oracle("describe_strings", f"""
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM (SELECT "column", value, count(*) AS n
      FROM (UNPIVOT (SELECT {", ".join(_STRINGS)} FROM feature_t) ON COLUMNS(*) INTO NAME "column" VALUE value)
      GROUP BY 1, 2)
GROUP BY 1""")
oracle("distinct_counts", f"""
UNPIVOT (SELECT {", ".join(f"count(DISTINCT {c}) AS {c}" for c, _ in _FEATURE_TYPES)} FROM feature_t)
ON COLUMNS(*) INTO NAME "column" VALUE n_unique""")
oracle("sorted_lines", f"SELECT {LINE_COLS} FROM pl_t", DAYS)
oracle("row_slice", """
SELECT order_id, user_id, add_to_cart_order, reordered, product_name, department FROM pl_t
ORDER BY order_id, add_to_cart_order LIMIT 12 OFFSET 6""")
oracle("format_metrics", """
SELECT product_id, p_total_purchases, printf('%.10f', p_reorder_ratio) AS p_reorder_ratio,
       printf('%.5f', mean_add_to_cart_order) AS mean_add_to_cart_order FROM prd_t""")
oracle("labelled_users", """
SELECT u.*, l.cluster FROM urows_t u JOIN lab_t l ON u.user_id = l.user_id""", USER_DOUBLES)
oracle("cluster_sizes", "SELECT * FROM csize_t")
oracle("segment_rows", """
SELECT m.user_id, m.product_name, m.value, l.cluster FROM mx_t m JOIN lab_t l ON m.user_id = l.user_id
WHERE l.cluster = 1""", ("value",))
oracle("segment_bases", """
UNPIVOT (SELECT l.cluster, avg(u.avg_days_since_prior_order) AS avg_days_since_prior_order,
                avg(u.u_reordered_ratio) AS u_reordered_ratio, avg(u.u_total_orders) AS u_total_orders,
                avg(u.order_size_avg) AS order_size_avg
         FROM urows_t u JOIN lab_t l ON u.user_id = l.user_id GROUP BY l.cluster)
ON avg_days_since_prior_order, u_reordered_ratio, u_total_orders, order_size_avg
INTO NAME feature VALUE mean""", ("mean",))
oracle("segment_product_means", "SELECT * FROM segpm_t", ("mean",))
oracle("user_aisle_matrix", "SELECT * FROM uam_t", ("value",))
oracle("user_department_matrix", "SELECT * FROM udm_t", ("value",))
oracle("segment_aisle_means", "SELECT * FROM segam_t", ("mean",))
oracle("segment_department_means", "SELECT * FROM segdm_t", ("mean",))
oracle("aisle_product_counts", """
SELECT aisle, count(*) AS n_products FROM lk_t GROUP BY aisle ORDER BY n_products DESC, aisle LIMIT 5""")
oracle("department_product_counts", """
SELECT department, count(*) AS n_products FROM lk_t GROUP BY department
ORDER BY n_products DESC, department LIMIT 5""")
for _cte, _name in [("rkp_t", "products"), ("rka_t", "aisles"), ("rkd_t", "departments")]:
    oracle(f"segment_top10_{_name}", f"""
SELECT cluster, r_top AS rank, item, mean FROM {_cte} WHERE r_top <= 10""", ("mean",))
    oracle(f"segment_extremes_{_name}", f"""
SELECT cluster, 'top' AS "end", r_top AS rank, item, mean FROM {_cte} WHERE r_top <= 5
UNION ALL
SELECT cluster, 'bottom' AS "end", r_bottom AS rank, item, mean FROM {_cte} WHERE r_bottom <= 5""",
           ("mean",))


# ------------------------------------------------------- latent and sources --
oracle("scan_csv", "SELECT * FROM orders_t", DAYS)
oracle("scan_csv_names", """
SELECT product_id, '"Big" ' || product_name || ', dark' || chr(10) || '"x"' AS product_name, aisle_id, department_id
FROM products_t""")
oracle("write_csv", "SELECT * FROM feature_t", FEATURE_DOUBLES)
oracle("write_latent", """
SELECT model, count(*) AS users, CAST(sum(n) AS BIGINT) AS "values"
FROM (SELECT model, user_id, count(*) AS n FROM latv_t GROUP BY 1, 2) GROUP BY model""")
oracle("scan_npy", "SELECT model, user_id, dim, value FROM latv_t", ("value",))
oracle("sql_sticky", "SELECT user_id, product_id, sticky FROM sticky_t", ("sticky",))
oracle("scan_latent", "SELECT model, user_id, dim, value FROM latv_t", ("value",))


def _weights_sql() -> str:
    def ker(layer, rows, cols):
        return (f"SELECT {layer} AS layer, 'kernel' AS kind, CAST(a.i AS INTEGER) AS row, "
                f"CAST(b.j AS INTEGER) AS col, {_w(layer, 'a.i', 'b.j')} AS value "
                f"FROM {rows} a CROSS JOIN {cols} b")

    def bias(layer, cols):
        return (f"SELECT {layer} AS layer, 'bias' AS kind, 0 AS row, CAST(b.j AS INTEGER) AS col, "
                f"{_b('b.j')} AS value FROM {cols} b")
    d_i, d_j = "(SELECT idx AS i FROM idx_t)", "(SELECT idx AS j FROM idx_t)"
    r = lambda n, c: f"(SELECT range AS {c} FROM range({n}))"
    parts = [ker(0, d_i, r(8, "j")), bias(0, r(8, "j")), ker(1, r(8, "i"), r(4, "j")), bias(1, r(4, "j")),
             ker(2, r(4, "i"), d_j), bias(2, d_j),
             "SELECT -1 AS layer, 'centroid' AS kind, CAST(cluster AS INTEGER) AS row, dim AS col, c AS value FROM cent_t"]
    return "\nUNION ALL\n".join(parts)


oracle("weights_roundtrip", _weights_sql(), ("value",))


def _histogram_sql(src: str, value: str, bins: int) -> str:
    b = f"CAST({bins} AS DOUBLE)"
    return f"""
SELECT e.model, e.bin, e.vmin + e.bin * ((e.vmax - e.vmin) / {b}) AS lo,
       e.vmin + (e.bin + 1) * ((e.vmax - e.vmin) / {b}) AS hi, COALESCE(c.count, 0) AS count
FROM (SELECT model, vmin, vmax, CAST(unnest(generate_series(0, {bins - 1})) AS INTEGER) AS bin
      FROM (SELECT model, min({value}) AS vmin, max({value}) AS vmax FROM {src} GROUP BY model)) e
LEFT JOIN (SELECT s.model,
                  CAST(CASE WHEN r.vmax - r.vmin = 0 THEN 0
                       ELSE least({bins - 1}, floor((s.{value} - r.vmin) / (r.vmax - r.vmin) * {b})) END
                       AS INTEGER) AS bin,
                  count(*) AS count
           FROM {src} s JOIN (SELECT model, min({value}) AS vmin, max({value}) AS vmax FROM {src}
                              GROUP BY model) r ON s.model = r.model
           GROUP BY 1, 2) c ON e.model = c.model AND e.bin = c.bin"""


oracle("latent_histogram", _histogram_sql("latv_t", "value", 100), ("lo", "hi"))
oracle("mean_activations", "SELECT * FROM mact_t", ("mean_activation",))
oracle("activation_histogram", _histogram_sql("mact_t", "mean_activation", 50), ("lo", "hi"))
oracle("latent_sparsity", """
SELECT v.model, avg(CAST(abs(v.value) < CAST(0.05 AS DOUBLE) * m.vmax AS DOUBLE)) * CAST(100 AS DOUBLE)
       AS sparsity_percent
FROM latv_t v JOIN (SELECT model, max(value) AS vmax FROM latv_t GROUP BY model) m ON v.model = m.model
GROUP BY v.model""", ("sparsity_percent",))
oracle("latent_variance", "SELECT model, var_pop(value) AS variance FROM latv_t GROUP BY model",
       ("variance",))
oracle("soft_assignment", "SELECT user_id, cluster, q FROM q_t", ("q",))
oracle("target_distribution", "SELECT user_id, cluster, q, p FROM p_t", ("q", "p"))
oracle("sql_target_distribution", "SELECT user_id, cluster, q, p FROM p_t", ("q", "p"))
_EPS = "CAST(1e-7 AS DOUBLE)"
_ONE = "CAST(1 AS DOUBLE)"
oracle("kl_loss", f"""
SELECT avg(kl) AS kl_loss FROM (
  SELECT user_id, sum(least(greatest(p, {_EPS}), {_ONE})
                      * ln(least(greatest(p, {_EPS}), {_ONE}) / least(greatest(q, {_EPS}), {_ONE}))) AS kl
  FROM p_t GROUP BY user_id)""", ("kl_loss",))
oracle("hard_labels", """
SELECT user_id, cluster FROM (
  SELECT user_id, cluster, row_number() OVER (PARTITION BY user_id ORDER BY q DESC, cluster) AS rn
  FROM q_t) WHERE rn = 1""")
oracle("mean_assignment", "SELECT cluster, avg(q) AS mean_q, avg(p) AS mean_p FROM p_t GROUP BY 1",
       ("mean_q", "mean_p"))
oracle("label_churn", """
SELECT avg(CAST(a.cluster <> b.cluster AS DOUBLE)) AS delta_label
FROM (SELECT user_id, cluster FROM (SELECT user_id, cluster, row_number() OVER
        (PARTITION BY user_id ORDER BY d2, cluster) AS rn FROM d2_t) WHERE rn = 1) a
JOIN (SELECT user_id, cluster FROM (SELECT user_id, cluster, row_number() OVER
        (PARTITION BY user_id ORDER BY d2, cluster) AS rn FROM d22_t) WHERE rn = 1) b
ON a.user_id = b.user_id""", ("delta_label",))
# two steps of DEC on fixed latent vectors: the target p stays, q follows the moved centroids
BOOK.add("g1_t", """
SELECT w.cluster, v.dim, CAST(-2 AS DOUBLE) * sum(w.w * (v.value - c.c)) / any_value(n.n) AS g
FROM (SELECT p.user_id, p.cluster, (p.p - p.q) / (CAST(1 AS DOUBLE) + d.d2) AS w
      FROM p_t p JOIN d2_t d ON p.user_id = d.user_id AND p.cluster = d.cluster) w
JOIN lv0_t v ON v.user_id = w.user_id
JOIN cent_t c ON c.cluster = w.cluster AND c.dim = v.dim
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM lat_t) n
GROUP BY 1, 2""")
BOOK.add("centb_t", """
SELECT c.cluster, c.dim, c.c - CAST(0.0001 AS DOUBLE) * g.g AS c
FROM cent_t c JOIN g1_t g ON g.cluster = c.cluster AND g.dim = c.dim""")
BOOK.add("d2b_t", """
SELECT v.user_id, c.cluster, sum((v.value - c.c) * (v.value - c.c)) AS d2
FROM lv0_t v JOIN centb_t c ON v.dim = c.dim GROUP BY 1, 2""")
BOOK.add("qb_t", """
SELECT user_id, cluster, d2, k / sum(k) OVER (PARTITION BY user_id) AS q
FROM (SELECT user_id, cluster, d2, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + d2) AS k FROM d2b_t)""")
BOOK.add("g2_t", """
SELECT w.cluster, v.dim, CAST(-2 AS DOUBLE) * sum(w.w * (v.value - c.c)) / any_value(n.n) AS g
FROM (SELECT p.user_id, p.cluster, (p.p - b.q) / (CAST(1 AS DOUBLE) + b.d2) AS w
      FROM p_t p JOIN qb_t b ON p.user_id = b.user_id AND p.cluster = b.cluster) w
JOIN lv0_t v ON v.user_id = w.user_id
JOIN centb_t c ON c.cluster = w.cluster AND c.dim = v.dim
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM lat_t) n
GROUP BY 1, 2""")
oracle("dec_step", """
SELECT CAST(a.cluster AS INTEGER) AS cluster, a.dim, CAST(1e6 AS DOUBLE) * a.g AS gradient,
       CAST(-1e6 AS DOUBLE) * (CAST(0.1 AS DOUBLE) * a.g + b.g) AS update2,
       CAST(-100 AS DOUBLE) * (CAST(1.1 AS DOUBLE) * a.g + b.g) AS moved
FROM g1_t a JOIN g2_t b ON a.cluster = b.cluster AND a.dim = b.dim""", ("gradient", "update2", "moved"))
oracle("lloyd_step", """
SELECT l.cluster, v.dim, avg(v.value) AS mean, count(*) AS users
FROM (SELECT user_id, CAST(cluster AS INTEGER) AS cluster, row_number() OVER
        (PARTITION BY user_id ORDER BY d2, cluster) AS rn FROM d2_t) l
JOIN lv0_t v ON v.user_id = l.user_id WHERE l.rn = 1 GROUP BY 1, 2""", ("mean",))
# one combined step of three models: the nearest of the first k label centroids
BOOK.add("lc_t", """
SELECT CAST(l.label AS INTEGER) AS cluster, v.dim, avg(v.value) AS c
FROM lv0_t v JOIN lat_t l ON l.user_id = v.user_id WHERE l.label < 4 GROUP BY 1, 2""")
BOOK.add("ld_t", """
SELECT v.user_id, c.cluster, sum((v.value - c.c) * (v.value - c.c)) AS d2
FROM lv0_t v JOIN lc_t c ON v.dim = c.dim GROUP BY 1, 2""")
BOOK.add("ln_t", """
SELECT m.k, d.user_id, d.cluster, d.d2,
       row_number() OVER (PARTITION BY m.k, d.user_id ORDER BY d.d2, d.cluster) AS rn
FROM ld_t d JOIN (SELECT CAST(unnest([2, 3, 4]) AS INTEGER) AS k) m ON d.cluster < m.k""")
oracle("lloyd_many_step", """
SELECT n.k, n.cluster, v.dim, avg(v.value) AS mean, count(*) AS users, any_value(t.cost) AS cost
FROM ln_t n JOIN lv0_t v ON v.user_id = n.user_id
JOIN (SELECT k, sum(d2) AS cost FROM ln_t WHERE rn = 1 GROUP BY 1) t ON t.k = n.k
WHERE n.rn = 1 GROUP BY 1, 2, 3""", ("mean", "cost"))
oracle("elbow_invariants", """
SELECT unnest(['k1_is_total', 'all_k', 'never_rises']) AS invariant, true AS holds""")
oracle("kmeans_fixed_point", """
SELECT count(*) AS users, 3 AS clusters, CAST(0 AS BIGINT) AS users_not_at_nearest, true AS centres_are_means
FROM lat_t""")
oracle("dec_one_stage", """
SELECT count(*) AS users, CAST(0 AS BIGINT) AS users_apart, true AS stopped_by_rule FROM lat_t""")
oracle("describe_latent", """
SELECT 'z' || dim AS "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, max(value) AS max
FROM lv0_t GROUP BY dim""", _DESC)

# affinities of the 2-D map: 90 nearest neighbours, the precision of perplexity 30 by bisection on its logarithm
oracle("neighbour_affinities", """SELECT * FROM (
WITH RECURSIVE d AS (
  SELECT a.user_id, b.user_id AS other, sum((a.value - b.value) * (a.value - b.value)) AS d2
  FROM lv0_t a JOIN lv0_t b ON a.dim = b.dim WHERE a.user_id <> b.user_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d2, other) AS rn FROM d),
n AS (SELECT user_id, list(d2 - m ORDER BY rn) AS ds, list(other ORDER BY rn) AS others
      FROM (SELECT *, min(d2) OVER (PARTITION BY user_id) AS m FROM r WHERE rn <= 90) GROUP BY 1),
s AS (SELECT user_id, 0 AS it, CAST(-50 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi FROM n
      UNION ALL
      SELECT user_id, it + 1, CASE WHEN e > ln(30) THEN mid ELSE lo END, CASE WHEN e > ln(30) THEN hi ELSE mid END
      FROM (SELECT user_id, it, lo, hi, mid,
                   ln(list_sum(w)) + exp(mid) * list_sum(list_transform(range(len(w)), lambda i: w[i + 1] * ds[i + 1]))
                   / list_sum(w) AS e
            FROM (SELECT s.user_id, s.it, s.lo, s.hi, (s.lo + s.hi) / 2 AS mid, n.ds,
                         list_transform(n.ds, lambda x: exp(-exp((s.lo + s.hi) / 2) * x)) AS w
                  FROM s JOIN n ON n.user_id = s.user_id WHERE s.it < 80))),
w AS (SELECT n.user_id, unnest(n.others) AS other, unnest(list_transform(n.ds, lambda x: exp(-exp(s.lo) * x))) AS w
      FROM s JOIN n ON n.user_id = s.user_id WHERE s.it = 80),
p AS (SELECT user_id, other, w / sum(w) OVER (PARTITION BY user_id) AS p FROM w)
SELECT user_id, other, sum(p) AS affinity
FROM (SELECT user_id, other, p FROM p UNION ALL SELECT other, user_id, p FROM p) GROUP BY 1, 2)""", ("affinity",))

# one full-data pass of the fixture autoencoder (d -> 8 -> 4 -> d), L1 1e-3
BOOK.add("dz3_t", """
SELECT o.user_id, o.j, (CAST(2 AS DOUBLE) / d.d) * (o.y - COALESCE(t.value, 0)) * o.y * (1 - o.y) AS g
FROM out_t o LEFT JOIN tri_t t ON o.user_id = t.user_id AND o.j = t.idx
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS d FROM idx_t) d""")
BOOK.add("dz2_t", f"""
SELECT h.user_id, h.k, (b.s + CAST(1e-3 AS DOUBLE)) * h.a * (1 - h.a) AS g
FROM h2_t h JOIN (SELECT z.user_id, r.k, sum(z.g * {_w(2, 'r.k', 'z.j')}) AS s
                  FROM dz3_t z CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(4)) r
                  GROUP BY z.user_id, r.k) b ON b.user_id = h.user_id AND b.k = h.k""")
BOOK.add("dz1_t", f"""
SELECT h.user_id, h.j, (b.s + CAST(1e-3 AS DOUBLE)) * h.a * (1 - h.a) AS g
FROM h1_t h JOIN (SELECT z.user_id, r.j, sum(z.g * {_w(1, 'r.j', 'z.k')}) AS s
                  FROM dz2_t z CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(8)) r
                  GROUP BY z.user_id, r.j) b ON b.user_id = h.user_id AND b.j = h.j""")


def _gradient_sql() -> str:
    k = "CAST(1000 AS DOUBLE)"
    parts = [
        f"""SELECT 0 AS layer, 'kernel' AS kind, c.i AS row, c.j AS col, {k} * COALESCE(s.g, 0) AS value
FROM (SELECT a.idx AS i, b.j FROM idx_t a CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(8)) b) c
LEFT JOIN (SELECT t.idx AS i, z.j, sum(t.value * z.g) AS g FROM tri_t t JOIN dz1_t z ON z.user_id = t.user_id
           GROUP BY 1, 2) s ON s.i = c.i AND s.j = c.j""",
        f"SELECT 0, 'bias', 0, j, {k} * sum(g) FROM dz1_t GROUP BY j",
        f"""SELECT 1, 'kernel', h.j, z.k, {k} * sum(h.a * z.g)
FROM h1_t h JOIN dz2_t z ON z.user_id = h.user_id GROUP BY h.j, z.k""",
        f"SELECT 1, 'bias', 0, k, {k} * sum(g) FROM dz2_t GROUP BY k",
        f"""SELECT 2, 'kernel', h.k, z.j, {k} * sum(h.a * z.g)
FROM h2_t h JOIN dz3_t z ON z.user_id = h.user_id GROUP BY h.k, z.j""",
        f"SELECT 2, 'bias', 0, j, {k} * sum(g) FROM dz3_t GROUP BY j"]
    return "\nUNION ALL\n".join(parts)


oracle("autoencoder_gradient", _gradient_sql(), ("value",))
oracle("autoencoder_loss", """
SELECT count(*) AS users, avg(m.mse + CAST(1e-3 AS DOUBLE) * (a.s + b.s)) AS loss, avg(m.mse) AS mse
FROM umse_t m JOIN (SELECT user_id, sum(a) AS s FROM h1_t GROUP BY 1) a ON a.user_id = m.user_id
JOIN (SELECT user_id, sum(a) AS s FROM h2_t GROUP BY 1) b ON b.user_id = m.user_id""", ("loss", "mse"))

# one Adam step (fixed values of the optimiser) from the fixture weights: the gradient is the mean over the users
BOOK.add("agrad_t", _gradient_sql())
_ADAM_G = "(a.value / CAST(1000 AS DOUBLE) / n.n)"
oracle("autoencoder_adam_step", f"""
SELECT a.layer, a.kind, a.row, a.col, CAST(1000 AS DOUBLE) * (
         CASE WHEN a.kind = 'kernel' THEN CASE a.layer WHEN 0 THEN {_w(0, 'a.row', 'a.col')}
              WHEN 1 THEN {_w(1, 'a.row', 'a.col')} ELSE {_w(2, 'a.row', 'a.col')} END ELSE {_b('a.col')} END
         - CAST(1e-3 AS DOUBLE) * sqrt(CAST(1e-3 AS DOUBLE)) * {_ADAM_G}
           / (sqrt(CAST(1e-3 AS DOUBLE)) * abs({_ADAM_G}) + CAST(1e-7 AS DOUBLE))) AS value
FROM agrad_t a CROSS JOIN (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS n FROM h1_t) n""", ("value",))
oracle("chain_invariants", """
SELECT unnest(['labels_are_argmax', 'best_epoch_is_least', 'fit_stopped_by_rule', 'dec_stopped_by_rule',
               'one_label_per_user']) AS invariant, true AS holds""")

# a saved encoder and its centroids (means of the latent vectors of user_id % 3)
BOOK.add("zc_t", """
SELECT l.cluster, h.k, avg(h.a) AS c FROM h2_t h JOIN lab_t l ON l.user_id = h.user_id GROUP BY 1, 2""")
BOOK.add("zq_t", """
SELECT user_id, cluster, w / sum(w) OVER (PARTITION BY user_id) AS q
FROM (SELECT h.user_id, c.cluster, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + sum((h.a - c.c) * (h.a - c.c))) AS w
      FROM h2_t h JOIN zc_t c ON c.k = h.k GROUP BY 1, 2)""")
BOOK.add("zp_t", """
SELECT user_id, cluster, q, w / sum(w) OVER (PARTITION BY user_id) AS p
FROM (SELECT q.user_id, q.cluster, q.q, q.q * q.q / f.f AS w
      FROM zq_t q JOIN (SELECT cluster, sum(q) AS f FROM zq_t GROUP BY 1) f ON f.cluster = q.cluster)""")
oracle("score_saved_model", """
SELECT user_id, cluster, q, p,
       CAST(first_value(cluster) OVER (PARTITION BY user_id ORDER BY q DESC, cluster) AS INTEGER) AS label
FROM zp_t""", ("q", "p"))


def _silhouette_sql(triples: str, labels: str) -> str:
    return f"""SELECT * FROM (
WITH tl AS (SELECT t.user_id, t.idx, t.value, l.cluster FROM {triples} t JOIN {labels} l ON t.user_id = l.user_id),
sums AS (SELECT cluster, idx, sum(value) AS s FROM tl GROUP BY 1, 2),
norms AS (SELECT user_id, cluster, sum(value * value) AS nx FROM tl GROUP BY 1, 2),
sizes AS (SELECT cluster, count(*) AS n_c, sum(nx) AS q_c FROM norms GROUP BY 1),
dots AS (SELECT t.user_id, s.cluster AS other, sum(t.value * s.s) AS xs
         FROM {triples} t JOIN sums s ON t.idx = s.idx GROUP BY 1, 2),
dist AS (SELECT n.user_id, n.cluster, z.cluster AS other, z.n_c,
                z.n_c * n.nx - 2 * COALESCE(d.xs, 0) + z.q_c AS total
         FROM norms n CROSS JOIN sizes z
         LEFT JOIN dots d ON d.user_id = n.user_id AND d.other = z.cluster),
per AS (SELECT user_id, cluster,
               max(CASE WHEN other = cluster THEN n_c END) AS own_n,
               max(CASE WHEN other = cluster THEN total END) AS own_total,
               min(CASE WHEN other <> cluster THEN total / n_c END) AS b
        FROM dist GROUP BY 1, 2)
SELECT avg(CASE WHEN own_n <= 1 THEN CAST(0 AS DOUBLE)
                ELSE (b - own_total / (own_n - 1)) / greatest(own_total / (own_n - 1), b) END) AS silhouette
FROM per)"""


oracle("silhouette_sq", _silhouette_sql(
    "(SELECT user_id, dim AS idx, value FROM lv0_t)", "(SELECT user_id, label AS cluster FROM lat_t)"),
    ("silhouette",))
oracle("silhouette_sq_basket", _silhouette_sql("tri_t", "lab_t"), ("silhouette",))


def _euclidean_sql(triples: str, labels: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (
WITH lab AS (SELECT user_id, cluster FROM {labels}),
tri AS (SELECT t.user_id, t.idx, t.value FROM {triples} t JOIN lab l ON l.user_id = t.user_id),
nrm AS (SELECT user_id, sum(value * value) AS nx FROM tri GROUP BY 1),
dot AS (SELECT a.user_id, b.user_id AS other, sum(a.value * b.value) AS xy
        FROM tri a JOIN tri b ON a.idx = b.idx GROUP BY 1, 2),
dist AS (SELECT a.user_id, a.cluster AS own, b.cluster,
                sqrt(greatest(COALESCE(na.nx, 0) + COALESCE(nb.nx, 0) - 2 * COALESCE(d.xy, 0), 0)) AS dist,
                a.user_id = b.user_id AS self
         FROM lab a CROSS JOIN lab b LEFT JOIN nrm na ON na.user_id = a.user_id LEFT JOIN nrm nb ON nb.user_id = b.user_id
         LEFT JOIN dot d ON d.user_id = a.user_id AND d.other = b.user_id),
per AS (SELECT user_id, own, cluster, sum(CASE WHEN self THEN 0 ELSE dist END) AS total, count(*) AS n
        FROM dist GROUP BY 1, 2, 3),
ab AS (SELECT user_id, max(CASE WHEN own = cluster THEN n END) AS n,
              max(CASE WHEN own = cluster AND n > 1 THEN total / (n - 1) END) AS a,
              min(CASE WHEN own <> cluster THEN total / n END) AS b FROM per GROUP BY 1)
SELECT avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette,
       CAST(0 AS DOUBLE) AS standard_error, count(*) AS users, count(*) AS sampled, true AS exact FROM ab)"""


oracle("silhouette_euclidean", _euclidean_sql(
    "(SELECT user_id, dim AS idx, value FROM lv0_t)", "(SELECT user_id, label AS cluster FROM lat_t)",
    "silhouette, users"), ("silhouette",))
oracle("silhouette_euclidean_basket", _euclidean_sql("tri_t", "lab_t", "*"), ("silhouette", "standard_error"))
oracle("encode_latent", "SELECT user_id, k AS dim, a AS value FROM h2_t", ("value",))
oracle("reconstruction_error", f"""
SELECT CASE WHEN {_hash(7)} < {int(0.2 * 2 ** 32)} THEN 'validation' ELSE 'train' END AS split,
       avg(mse) AS mse, count(*) AS users
FROM umse_t GROUP BY 1""", ("mse",))
oracle("elbow_k1", """
SELECT sum((v.value - m.m) * (v.value - m.m)) AS inertia
FROM lv0_t v JOIN (SELECT dim, avg(value) AS m FROM lv0_t GROUP BY dim) m ON v.dim = m.dim""", ("inertia",))

# ------------------------------------------------- matrix blocks and sketches --
oracle("block_column_sums", """
SELECT idx, sum(value) AS total, count(*) AS n_cells FROM tri_t GROUP BY 1""", ("total",))
oracle("block_transpose", "SELECT idx, user_id, value FROM tri_t", ("value",))
oracle("block_gram", """
SELECT a.idx, b.idx AS idx2, sum(a.value * b.value) AS value
FROM tri_t a JOIN tri_t b ON a.user_id = b.user_id GROUP BY 1, 2 HAVING sum(a.value * b.value) <> 0""", ("value",))
_RANGE = [f"c{i}" for i in range(14, 20)]
oracle("matrix_column_range", "SELECT user_id, " + ", ".join(
    f"coalesce(sum(value) FILTER (idx = {c[1:]}), 0) AS {c}" for c in _RANGE) + " FROM tri_t GROUP BY 1", tuple(_RANGE))
oracle("encode_latent_blocks", "SELECT user_id, k AS dim, a AS value FROM h2_t", ("value",))
oracle("profile_sketch", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values, avg(CAST({c} AS DOUBLE)) AS mean,
       CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
       true AS distinct_within, true AS quartiles_within FROM data_t"""
    for c in ("order_number", "order_dow", "days_since_prior_order", "add_to_cart_order", "user_id", "product_id")),
    ("mean", '"min"', '"max"'))

# --------------------------------------------------------- stages keyed by user --
oracle("user_features_keyed", "SELECT * FROM user_t", USER_DOUBLES)
oracle("sticky_keyed", "SELECT user_id, product_id, sticky FROM sticky_t", ("sticky",))
oracle("user_vectors_keyed", """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS INTEGER) AS k, idx, value
FROM tri_t""", ("value",))
