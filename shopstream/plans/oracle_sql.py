"""DuckDB SQL that computes the same result as each registered query.

Tables ``events lineitem orders part embeddings ...`` are views over the
same Parquet files.  Adapters (FIXTURES.md) are repeated here as CTEs.
"""

from __future__ import annotations

from shopstream.operators.model import STEPS, octaves

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    if name in ORACLES:
        raise ValueError(f"duplicate oracle {name}")
    ORACLES[name] = sql


# --- adapters -------------------------------------------------------------

CLICKS = """
clicks AS (
  SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(sid AS VARCHAR)) AS user_session,
         ts AS event_time, event_id, event_type, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id
  FROM (SELECT *, sum(CASE WHEN pt IS NULL OR ts - pt >= INTERVAL '720' MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events) a) b
)"""

# sessions of X1: min length 2, cap = max(floor(p95 of usable lengths), 2), keep the last cap items
SESSIONS = CLICKS + """,
c_lens AS (SELECT user_session, count(*) AS raw_len, min(event_time) AS start_time FROM clicks GROUP BY user_session),
c_cap AS (SELECT greatest(CAST(floor(quantile_cont(raw_len, 0.95)) AS INTEGER), 2) AS cap FROM c_lens WHERE raw_len >= 2),
c_ranked AS (SELECT *, row_number() OVER (PARTITION BY user_session ORDER BY event_time DESC, event_id DESC) AS rk FROM clicks),
c_items AS (
  SELECT r.user_session, r.event_time, r.event_id, r.product_id,
         row_number() OVER (PARTITION BY r.user_session ORDER BY r.event_time, r.event_id) AS pos
  FROM c_ranked r, c_cap WHERE r.rk <= c_cap.cap
),
sessions AS (
  SELECT l.user_session, l.start_time,
         list(i.product_id ORDER BY i.pos) AS product_seq,
         CAST(count(*) AS INTEGER) AS session_len
  FROM c_lens l JOIN c_items i USING (user_session)
  WHERE l.raw_len >= 2
  GROUP BY l.user_session, l.start_time
)"""

CLICK_VOCAB = SESSIONS + """,
c_counts AS (SELECT product_id, count(*) AS n FROM c_items i JOIN c_lens l USING (user_session) WHERE l.raw_len >= 2 GROUP BY product_id),
vocab AS (
  SELECT product_id, CAST(row_number() OVER (ORDER BY n DESC, product_id) + 2 AS INTEGER) AS token_id, n
  FROM c_counts ORDER BY n DESC, product_id LIMIT 60
)"""

# encoded items of every session: (user_session, pos, product_id, token)
CLICK_ENCODED = CLICK_VOCAB + """,
c_tok AS (
  SELECT i.user_session, i.pos, i.product_id, CAST(coalesce(v.token_id, 2) AS INTEGER) AS tok
  FROM c_items i JOIN c_lens l USING (user_session) LEFT JOIN vocab v USING (product_id)
  WHERE l.raw_len >= 2
),
encoded AS (
  SELECT user_session, list(tok ORDER BY pos) AS token_seq FROM c_tok GROUP BY user_session
)"""


def w(cte: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + cte.strip() + "\n" + body


# --- load / export --------------------------------------------------------

oracle("load_profile", "SELECT count(*) AS total_rows, min(ts) AS min_time, max(ts) AS max_time FROM events")
oracle("event_type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
oracle("export_window", """
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
oracle("export_window_limit", """
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts, event_id LIMIT 1000""")

# appended in loads that overlap and repeat: every event once, equal events of one file each
oracle("events_append", "SELECT event_id, ts, user_id, event_type, value FROM events")
oracle("csv_append", """
SELECT l_shipdate AS event_time, l_returnflag AS event_type, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS category_id,
       CASE WHEN l_orderkey % 7 = 0 OR p_type = '' THEN NULL ELSE p_type END AS category_code,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE p_brand || ', "' || l_returnflag || '"' END AS brand,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price, l_suppkey AS user_id, CAST(l_orderkey AS VARCHAR) AS user_session
FROM lineitem JOIN part ON l_partkey = p_partkey""")

# --- sessions -------------------------------------------------------------

oracle("sessions_raw", w(CLICKS, """
SELECT user_session, min(event_time) AS start_time, count(*) AS raw_len,
       arg_max(product_id, (event_time, event_id)) AS last_item
FROM clicks GROUP BY user_session"""))

oracle("session_len_cap", w(CLICKS, """,
l AS (SELECT user_session, count(*) AS raw_len FROM clicks GROUP BY user_session)
SELECT quantile_cont(raw_len, 0.95) AS length_percentile,
       greatest(CAST(floor(quantile_cont(raw_len, 0.95)) AS INTEGER), 2) AS cap
FROM l WHERE raw_len >= 2"""))

oracle("sessions", w(SESSIONS, """
SELECT user_session, start_time, array_to_string(product_seq, ' ') AS product_seq, session_len FROM sessions"""))

oracle("sessions_stored", ORACLES["sessions"])
oracle("session_len_describe", w(SESSIONS, """
SELECT count(session_len) AS n, round(avg(session_len), 9) AS mean, round(stddev_samp(session_len), 9) AS std,
       min(session_len) AS min, quantile_cont(session_len, 0.25) AS p25, quantile_cont(session_len, 0.5) AS p50,
       quantile_cont(session_len, 0.75) AS p75, max(session_len) AS max
FROM sessions"""))

oracle("dataset_profile", w(CLICKS, """,
l AS (SELECT user_session, count(*) AS n FROM clicks GROUP BY user_session)
SELECT (SELECT count(*) FROM clicks) AS events, count(*) AS sessions,
       count(*) FILTER (WHERE n = 1) AS one_event_sessions,
       count(*) FILTER (WHERE n >= 2) AS usable_sessions,
       (SELECT count(DISTINCT product_id) FROM clicks) AS products,
       CAST(sum(CASE WHEN n >= 2 THEN n - 1 ELSE 0 END) AS BIGINT) AS pairs_before_cap
FROM l"""))

# --- vocabulary and sequences ---------------------------------------------

oracle("vocab_stored", w(CLICK_VOCAB, """
SELECT product_id, token_id, n, 3 AS num_special_tokens, (SELECT count(*) FROM vocab) AS vocab_size FROM vocab"""))
oracle("shuffled_rows", w(CLICK_ENCODED, """
SELECT user_session, CAST(pos - 1 AS INTEGER) AS pos, CAST(tok AS INTEGER) AS target,
       row_number() OVER (ORDER BY md5(concat_ws(':', user_session, CAST(pos - 1 AS INTEGER), 42)), user_session, pos) AS shuffled
FROM c_tok WHERE pos >= 2"""))

oracle("item_counts", w(SESSIONS, """
SELECT product_id, count(*) AS n FROM (SELECT unnest(product_seq) AS product_id FROM sessions) GROUP BY product_id"""))

oracle("vocab", w(CLICK_VOCAB, "SELECT product_id, token_id, n FROM vocab"))

oracle("encode", w(CLICK_ENCODED, """
SELECT user_session, array_to_string(token_seq, ' ') AS token_seq FROM encoded"""))

_PAIRS = """,
pairs AS (
  SELECT t.user_session, t.pos,
         (SELECT string_agg(CAST(p.tok AS VARCHAR), ' ' ORDER BY p.pos) FROM c_tok p
           WHERE p.user_session = t.user_session AND p.pos <= t.pos AND p.pos > t.pos - 20) AS prefix,
         n.tok AS target
  FROM c_tok t JOIN c_tok n ON n.user_session = t.user_session AND n.pos = t.pos + 1
)"""

oracle("training_pairs", w(CLICK_ENCODED + _PAIRS, "SELECT user_session, CAST(pos AS INTEGER) AS pos, prefix, target FROM pairs"))

oracle("padded_pairs", w(CLICK_ENCODED + _PAIRS, """
SELECT user_session, CAST(pos AS INTEGER) AS pos,
       concat_ws(' ', CASE WHEN pos < 20 THEN array_to_string(list_transform(range(20 - pos), lambda x: 0), ' ') END, prefix) AS prefix,
       target
FROM pairs"""))

oracle("eval_prefixes", w(CLICK_ENCODED, """
SELECT user_session,
       array_to_string(token_seq[greatest(len(token_seq) - 20, 1):len(token_seq) - 1], ' ') AS prefix,
       token_seq[len(token_seq)] AS target
FROM encoded WHERE len(token_seq) >= 2"""))

oracle("pair_count", w(SESSIONS, "SELECT CAST(sum(session_len - 1) AS BIGINT) AS pairs FROM sessions"))

oracle("time_split", w(SESSIONS, """,
m AS (SELECT max(start_time) AS mx FROM sessions)
SELECT user_session, start_time, session_len,
       CASE WHEN start_time >= mx - INTERVAL 3 DAY THEN 'test'
            WHEN start_time >= mx - INTERVAL 6 DAY THEN 'val' ELSE 'train' END AS split
FROM sessions, m"""))

oracle("eval_sample", w(SESSIONS, """
SELECT user_session, session_len FROM sessions
ORDER BY md5(concat(user_session, ':42')), user_session LIMIT 200"""))

oracle("rolling_window", w(CLICKS, """,
m AS (SELECT max(event_time) AS mx FROM clicks)
SELECT user_session, event_time, event_id, product_id FROM clicks, m
WHERE event_time >= mx - INTERVAL 7 DAY"""))

# --- catalog (X2 -> X3) -----------------------------------------------------

BASKETS = """
baskets AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS user_session, l_shipdate AS event_time, l_partkey AS product_id,
         l_returnflag AS event_type,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(10,2)) END AS price,
         CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 OR l_partkey % 13 = 0 THEN NULL
              ELSE lower(p_type) || '.' || split_part(p_name, ' ', 2) END AS category_code,
         CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 OR l_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand,
         l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

_OKEY = "(event_time, l_linenumber, product_id, l_orderkey, l_suppkey, l_extendedprice, l_quantity)"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def _title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '([{_CASED}]+|[^{_CASED}]+)', 1), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def _humanize(x: str) -> str:
    return _title(f"regexp_replace(translate({x}, '_-', '  '), '^\\s+|\\s+$', '', 'g')")


def _top(x: str) -> str:
    return f"list_filter(string_split({x}, '.'), lambda p: p <> '')[1]"


def _leaf(x: str) -> str:
    return f"list_filter(string_split({x}, '.'), lambda p: p <> '')[-1]"


def _reduce(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT product_id, count(*) AS event_count,
         arg_max(category_code, {_OKEY}) FILTER (WHERE category_code IS NOT NULL) AS category_code,
         arg_max(brand, {_OKEY}) FILTER (WHERE brand IS NOT NULL) AS brand,
         arg_max(price, {_OKEY}) FILTER (WHERE price IS NOT NULL) AS price,
         max(event_time) AS updated_at
  FROM {src} GROUP BY product_id
)"""


def _derive(src: str, name: str) -> str:
    leaf_name = f"CASE WHEN coalesce({_leaf('category_code')}, '') <> '' THEN {_humanize(_leaf('category_code'))} END"
    brand_name = f"CASE WHEN coalesce(brand, '') <> '' THEN {_humanize('brand')} END"
    return f"""
{name}_n AS (
  SELECT *, {leaf_name} AS _leaf_name, {brand_name} AS _brand_name FROM {src}
),
{name} AS (
  SELECT product_id, category_code, {_top('category_code')} AS category_top, {_leaf('category_code')} AS category_leaf,
         brand, price,
         CASE WHEN coalesce(_brand_name, '') <> '' AND coalesce(_leaf_name, '') <> '' THEN _brand_name || ' ' || _leaf_name
              WHEN coalesce(_brand_name, '') <> '' THEN _brand_name || ' Product'
              WHEN coalesce(_leaf_name, '') <> '' THEN _leaf_name
              ELSE 'Unbranded Product #' || CAST(product_id AS VARCHAR) END AS display_name,
         coalesce(nullif({_top('category_code')}, ''), 'generic') AS image_ref,
         CAST(event_count AS BIGINT) AS event_count, updated_at
  FROM {name}_n
)"""


PRODUCTS = BASKETS + "," + _reduce("baskets", "reduced") + "," + _derive("reduced", "products")
API = "product_id, display_name, brand, category_top, category_leaf, category_code, CAST(price AS DOUBLE) AS price, image_ref"
POOLS = """,
leaf_pools(category_top, category_leaf, n) AS (VALUES ('economy', 'ring', 6), ('small', 'bolt', 6)),
pools(category_top, n) AS (VALUES ('economy', 8), ('small', 8), ('medium', 8), ('promo', 8), ('generic', 8))"""

oracle("parse_category", w(BASKETS, f"""
SELECT DISTINCT category_code, {_top('category_code')} AS category_top, {_leaf('category_code')} AS category_leaf
FROM baskets"""))

oracle("catalog_reduce", w(BASKETS + "," + _reduce("baskets", "reduced"), """
SELECT product_id, event_count, category_code, brand, CAST(price AS DOUBLE) AS price, updated_at FROM reduced"""))

_CATALOG_SQL = w(PRODUCTS, """
SELECT product_id, category_code, category_top, category_leaf, brand, CAST(price AS DOUBLE) AS price,
       display_name, image_ref, event_count, updated_at FROM products""")
oracle("catalog", _CATALOG_SQL)
oracle("catalog_incremental", _CATALOG_SQL)

oracle("schema_violations", w(BASKETS, """,
v AS (SELECT count(*) FILTER (WHERE l_linenumber <= 1) AS event_id, count(*) FILTER (WHERE event_time IS NULL) AS event_time,
             count(*) FILTER (WHERE event_type IS NULL) AS event_type, count(*) FILTER (WHERE product_id IS NULL) AS product_id,
             count(*) FILTER (WHERE l_suppkey IS NULL) AS user_id, count(*) FILTER (WHERE user_session IS NULL) AS user_session FROM baskets)
SELECT "column", violations FROM (UNPIVOT v ON event_id, event_time, event_type, product_id, user_id, user_session INTO NAME "column" VALUE violations)"""))

oracle("catalog_null_stats", w(PRODUCTS, """
SELECT count(*) AS products, count(*) FILTER (WHERE category_code IS NULL) AS null_category,
       count(*) FILTER (WHERE brand IS NULL) AS null_brand,
       count(*) FILTER (WHERE category_code IS NULL AND brand IS NULL) AS null_both
FROM products"""))

oracle("catalog_upsert", w(
    BASKETS + ",\nb_old AS (SELECT * FROM baskets WHERE event_time < TIMESTAMP '1999-01-01 00:00:00'),"
    "\nb_new AS (SELECT * FROM baskets WHERE event_time >= TIMESTAMP '1999-01-01 00:00:00'),"
    + _reduce("b_old", "r_old") + "," + _reduce("b_new", "r_new") + ","
    + _derive("r_old", "p_old") + "," + _derive("r_new", "p_new"), """
SELECT product_id, category_code, category_top, category_leaf, brand, CAST(price AS DOUBLE) AS price,
       display_name, image_ref, event_count, updated_at FROM p_new
UNION ALL
SELECT product_id, category_code, category_top, category_leaf, brand, CAST(price AS DOUBLE) AS price,
       display_name, image_ref, event_count, updated_at FROM p_old
WHERE product_id NOT IN (SELECT product_id FROM p_new)"""))

oracle("image_assign", w(PRODUCTS + POOLS, """
SELECT p.product_id, p.category_top, p.category_leaf,
       CASE WHEN p.category_top IS NOT NULL AND p.category_leaf IS NOT NULL AND l.n > 0
              THEN format('/images/{}/leaf-{}/{}.jpg', p.category_top, p.category_leaf, p.product_id % l.n + 1)
            WHEN p.category_top IS NOT NULL AND c.n > 0
              THEN format('/images/{}/{}.jpg', p.category_top, p.product_id % c.n + 1)
            WHEN g.n > 0 THEN format('/images/generic/{}.jpg', p.product_id % g.n + 1)
            ELSE '/icons/generic.svg' END AS image_url
FROM products p
LEFT JOIN leaf_pools l ON l.category_top = p.category_top AND l.category_leaf = p.category_leaf
LEFT JOIN pools c ON c.category_top = p.category_top
CROSS JOIN (SELECT max(n) FILTER (WHERE category_top = 'generic') AS n FROM pools) g"""))

oracle("category_cover", w(PRODUCTS + POOLS, """,
cats AS (SELECT category_top AS category, count(*) AS product_count FROM products WHERE category_top IS NOT NULL GROUP BY 1)
SELECT k.category, k.product_count,
       CASE WHEN c.n > 0 THEN format('/images/{}/1.jpg', k.category)
            WHEN g.n > 0 THEN '/images/generic/1.jpg' ELSE '/icons/generic.svg' END AS cover_url
FROM cats k LEFT JOIN pools c ON c.category_top = k.category
CROSS JOIN (SELECT max(n) FILTER (WHERE category_top = 'generic') AS n FROM pools) g"""))

oracle("leaf_share", w(PRODUCTS, """,
c AS (SELECT category_top, category_leaf, count(*) AS n FROM products WHERE category_top IS NOT NULL GROUP BY 1, 2)
SELECT category_top, category_leaf, n, n / sum(n) OVER (PARTITION BY category_top) AS share FROM c"""))

_LABEL = ("array_to_string(list_transform(regexp_extract_all(regexp_replace(category_top, '^([^_]*)_', '\\1 '), "
          "'([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9_]') "
          "THEN upper(r[1]) || r[2:] ELSE r END), '')")
oracle("display_labels", w(PRODUCTS, f"""
SELECT product_id, {_LABEL} AS category_label,
       CASE WHEN price IS NULL THEN '—' ELSE '$' || CAST(price AS VARCHAR) END AS price_label,
       {_humanize('brand')} AS brand_label
FROM products"""))

oracle("product_filter", w(PRODUCTS, f"SELECT {API} FROM products WHERE lower(category_top) = lower('economy')"))
oracle("product_search", w(PRODUCTS, f"""
SELECT {API} FROM products WHERE display_name ILIKE '%ring%' OR brand ILIKE '%ring%'"""))
oracle("product_search_wildcard", w(PRODUCTS, f"""
SELECT {API} FROM products WHERE display_name ILIKE '%brand#1_ g%' OR brand ILIKE '%brand#1_ g%'"""))
oracle("product_page", w(PRODUCTS, f"""
SELECT {API} FROM products WHERE lower(category_top) = lower('economy')
ORDER BY event_count DESC, product_id LIMIT 24 OFFSET 24"""))
oracle("page_info", w(PRODUCTS, """
SELECT 1 AS page, 24 AS page_size, count(*) AS total_items, CAST(ceil(count(*) / 24) AS BIGINT) AS total_pages
FROM products WHERE lower(category_top) = lower('economy') AND (display_name ILIKE '%brand#1%' OR brand ILIKE '%brand#1%')"""))
oracle("all_pages", w(PRODUCTS, """
SELECT CAST(ceil(rn / 24) AS INTEGER) AS page_no, CAST((rn - 1) % 24 + 1 AS INTEGER) AS page_pos, product_id
FROM (SELECT product_id, row_number() OVER (ORDER BY event_count DESC, product_id) AS rn FROM products)"""))
for _name in ("product_search", "product_search_wildcard", "all_pages"):
    oracle(f"{_name}_indexed", ORACLES[_name])
oracle("listing_page_indexed", w(PRODUCTS, f"SELECT {API} FROM products ORDER BY event_count DESC, product_id LIMIT 24 OFFSET 144"))
oracle("category_counts", w(PRODUCTS, """
SELECT category_top AS category, count(*) AS product_count FROM products WHERE category_top IS NOT NULL GROUP BY 1"""))

CART_COMMANDS = """
cmd_src AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq,
         CAST(o_custkey AS VARCHAR) AS cart_id, l_partkey, l_quantity, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
commands AS (
  SELECT seq, cart_id,
         CASE WHEN seq % 7 = 0 THEN 'del' WHEN seq % 5 = 0 THEN 'set' ELSE 'add' END AS op,
         CASE WHEN seq % 97 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS product_id,
         CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 5 = 0 THEN CAST(seq % 4 AS INTEGER)
              ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         l_shipdate AS at
  FROM cmd_src
)"""

oracle("product_lookup", w(PRODUCTS + "," + CART_COMMANDS, f"""
SELECT {API} FROM products WHERE product_id IN (SELECT product_id FROM commands)"""))
oracle("product_lookup_missing", w(PRODUCTS + "," + CART_COMMANDS, """
SELECT DISTINCT product_id FROM commands WHERE product_id NOT IN (SELECT product_id FROM products)"""))

oracle("home_rows", w(PRODUCTS, """,
top AS (SELECT category_top, count(*) AS product_count FROM products WHERE category_top IS NOT NULL
        GROUP BY 1 ORDER BY product_count DESC, category_top LIMIT 2),
r AS (SELECT p.*, t.product_count,
             row_number() OVER (PARTITION BY p.category_top ORDER BY p.event_count DESC, p.product_id) AS rank
      FROM products p JOIN top t USING (category_top))
SELECT category_top, product_count, CAST(rank AS INTEGER) AS rank, product_id, display_name, brand, category_leaf,
       category_code, CAST(price AS DOUBLE) AS price, image_ref
FROM r WHERE rank <= 8"""))

oracle("related_products", w(PRODUCTS, """,
top AS (SELECT category_top, product_id AS related_id,
               row_number() OVER (PARTITION BY category_top ORDER BY event_count DESC, product_id) AS r
        FROM products WHERE category_top IS NOT NULL),
j AS (SELECT p.product_id, t.related_id, t.r FROM products p JOIN top t USING (category_top)
      WHERE t.r <= 9 AND t.related_id <> p.product_id),
k AS (SELECT product_id, related_id, row_number() OVER (PARTITION BY product_id ORDER BY r) AS pos FROM j)
SELECT product_id, CAST(pos AS INTEGER) AS pos, related_id FROM k WHERE pos <= 8"""))

# --- carts (X4) ---------------------------------------------------------------

CART_ITEMS = """
cart_items AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cart_id, l_partkey AS product_id,
         CAST(sum(l_quantity) AS INTEGER) AS quantity, min(o_orderdate) AS added_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
)"""

_VIEW = """,
cart_view AS (
  SELECT i.cart_id, i.product_id, p.display_name, p.brand, p.price, p.image_ref, i.quantity,
         round(coalesce(p.price, 0) * i.quantity, 2) AS line_total, i.added_at
  FROM cart_items i JOIN products p USING (product_id)
)"""

oracle("cart_view", w(PRODUCTS + "," + CART_ITEMS + _VIEW, """
SELECT cart_id, product_id, display_name, brand, CAST(price AS DOUBLE) AS price, image_ref, quantity,
       CAST(line_total AS DOUBLE) AS line_total, added_at FROM cart_view"""))

oracle("cart_lines", w(PRODUCTS + "," + CART_ITEMS + _VIEW, """
SELECT cart_id, CAST(row_number() OVER (PARTITION BY cart_id ORDER BY added_at, product_id) AS INTEGER) AS line_no, product_id, quantity FROM cart_view"""))

oracle("cart_totals", w(PRODUCTS + "," + CART_ITEMS + _VIEW, """
SELECT cart_id, CAST(sum(quantity) AS BIGINT) AS total_items, CAST(round(sum(line_total), 2) AS DOUBLE) AS total_price
FROM cart_view GROUP BY cart_id"""))

# The oracle folds the commands one by one per (cart, product) with a
# recursive CTE: an independent formulation of the rules.
_FOLD = """,
checked AS (
  SELECT c.*,
         CASE WHEN c.cart_id IS NULL OR length(c.cart_id) < 1 OR length(c.cart_id) > 36 THEN 'bad_cart_id'
              WHEN c.op IS NULL OR c.op NOT IN ('add', 'set', 'del') THEN 'bad_op'
              WHEN c.op = 'add' AND (c.quantity IS NULL OR c.quantity < 1) THEN 'bad_quantity'
              WHEN c.op = 'set' AND c.quantity IS NULL THEN 'bad_quantity'
              WHEN c.op = 'add' AND c.product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product'
         END AS reason
  FROM commands c
),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY seq) AS i
  FROM checked WHERE reason IS NULL
),
fold(cart_id, product_id, i, present, qty, added_at, rejected) AS (
  SELECT DISTINCT cart_id, product_id, CAST(0 AS BIGINT), false, 0, CAST(NULL AS TIMESTAMP), false FROM steps
  UNION ALL
  SELECT f.cart_id, f.product_id, s.i,
         CASE WHEN s.op = 'add' THEN true
              WHEN s.op = 'del' OR s.quantity <= 0 THEN false
              ELSE f.present END,
         CASE WHEN s.op = 'add' THEN (CASE WHEN f.present THEN f.qty + s.quantity ELSE s.quantity END)
              WHEN s.op = 'del' OR s.quantity <= 0 THEN 0
              WHEN f.present THEN s.quantity ELSE f.qty END,
         CASE WHEN s.op = 'add' THEN (CASE WHEN f.present THEN f.added_at ELSE s.at END)
              WHEN s.op = 'del' OR s.quantity <= 0 THEN NULL
              ELSE f.added_at END,
         s.op IN ('set', 'del') AND NOT f.present
  FROM fold f JOIN steps s ON s.cart_id = f.cart_id AND s.product_id = f.product_id AND s.i = f.i + 1
),
final AS (
  SELECT f.* FROM fold f
  JOIN (SELECT cart_id, product_id, max(i) AS mi FROM fold GROUP BY 1, 2) m
    ON f.cart_id = m.cart_id AND f.product_id = m.product_id AND f.i = m.mi
  WHERE f.present
)"""

_CART_FOLD = PRODUCTS + "," + CART_COMMANDS + _FOLD

oracle("cart_apply", w(_CART_FOLD, """
SELECT cart_id, product_id, CAST(qty AS INTEGER) AS quantity, added_at FROM final""", recursive=True))

oracle("cart_rejects", w(_CART_FOLD, """
SELECT seq, cart_id, product_id, op, reason FROM checked WHERE reason IS NOT NULL
UNION ALL
SELECT s.seq, s.cart_id, s.product_id, s.op, 'not_in_cart' AS reason
FROM fold f JOIN steps s ON s.cart_id = f.cart_id AND s.product_id = f.product_id AND s.i = f.i
WHERE f.rejected""", recursive=True))

oracle("cart_apply_totals", w(_CART_FOLD, """,
carts AS (SELECT DISTINCT cart_id FROM checked WHERE reason IS NULL AND op = 'add'),
lines AS (SELECT f.cart_id, f.qty, round(coalesce(p.price, 0) * f.qty, 2) AS line_total
          FROM final f JOIN products p USING (product_id))
SELECT c.cart_id, CAST(coalesce(sum(l.qty), 0) AS BIGINT) AS total_items,
       CAST(coalesce(round(sum(l.line_total), 2), 0) AS DOUBLE) AS total_price
FROM carts c LEFT JOIN lines l USING (cart_id) GROUP BY c.cart_id""", recursive=True))

# --- model (X1) ----------------------------------------------------------------
# Transitions are a self join on positions here (the library generates lag
# pairs with array expressions instead).

MODEL_BASE = CLICK_ENCODED + """,
smax AS (SELECT max(start_time) AS mx FROM sessions),
ssplit AS (SELECT user_session, CASE WHEN start_time >= mx - INTERVAL 3 DAY THEN 'test'
                                     WHEN start_time >= mx - INTERVAL 6 DAY THEN 'val' ELSE 'train' END AS split
           FROM sessions, smax),
tok AS (SELECT t.*, s.split FROM c_tok t JOIN ssplit s USING (user_session))"""


MAX_LAG = 20  # items of a session that count


def _transitions(name: str, where: str, max_lag: int = MAX_LAG, decay: float = 0.5) -> str:
    return f""",
{name} AS (
  SELECT a.tok AS src, b.tok AS dst, sum(pow({decay}, b.pos - a.pos - 1)) AS weight, count(*) AS n
  FROM tok a JOIN tok b ON a.user_session = b.user_session AND b.pos - a.pos BETWEEN 1 AND {max_lag}
  WHERE {where} GROUP BY 1, 2
)"""


def _model(name: str, trans: str) -> str:
    return f""",
{name}_tot AS (SELECT src, sum(weight) AS t FROM {trans} GROUP BY src),
{name} AS (
  SELECT src, dst, p FROM (
    SELECT x.src, x.dst, x.weight / y.t AS p FROM {trans} x JOIN {name}_tot y USING (src))
)"""


def _eval_on(split: str, max_lag: int = MAX_LAG, decay: float = 0.5) -> str:
    return (MODEL_BASE + _transitions("tr", "a.split = 'train'", max_lag, decay) + _model("model", "tr") + f""",
prior AS (SELECT tok AS dst, count(*) AS prior_n FROM tok WHERE split = 'train' AND pos >= 2 GROUP BY 1),
tt AS (SELECT user_session, max(pos) AS n FROM tok WHERE split = '{split}' GROUP BY 1 HAVING max(pos) >= 2),
targets AS (SELECT t.user_session, k.tok AS target FROM tt t JOIN tok k ON k.user_session = t.user_session AND k.pos = t.n),
recent AS (SELECT k.user_session, k.tok AS src, t.n - k.pos AS lag FROM tt t
           JOIN tok k ON k.user_session = t.user_session AND k.pos < t.n AND t.n - k.pos <= {max_lag}),
scores AS (SELECT r.user_session, m.dst, sum(pow({decay}, r.lag - 1) * m.p) AS score
           FROM recent r JOIN model m USING (src) GROUP BY 1, 2),
popular AS (SELECT dst FROM prior ORDER BY prior_n DESC, dst LIMIT 10),
cand AS (SELECT user_session, dst, max(score) AS score FROM (
           SELECT * FROM scores UNION ALL SELECT t.user_session, p.dst, 0.0 FROM tt t CROSS JOIN popular p)
         GROUP BY 1, 2),
ranked AS (SELECT c.user_session, c.dst, round(c.score, 9) AS score,
                  row_number() OVER (PARTITION BY c.user_session
                                     ORDER BY round(c.score, 9) DESC, coalesce(pr.prior_n, 0) DESC, c.dst) AS rank
           FROM cand c LEFT JOIN prior pr USING (dst)),
preds AS (SELECT user_session, CAST(rank AS INTEGER) AS rank, dst AS token_id, score FROM ranked WHERE rank <= 10)""")


TEST_EVAL = _eval_on("test")

oracle("transitions", w(MODEL_BASE + _transitions("tr", "true"), "SELECT src, dst, weight, n FROM tr"))
oracle("transitions_merge", w(MODEL_BASE + _transitions("tr", "true"), "SELECT src, dst, weight, n FROM tr"))
oracle("item_prior", w(MODEL_BASE, """
SELECT tok AS dst, count(*) AS prior_n FROM tok WHERE split = 'train' AND pos >= 2 GROUP BY 1"""))
oracle("recommend_eval", w(TEST_EVAL, "SELECT * FROM preds"))
oracle("eval_metrics", w(TEST_EVAL, """
SELECT count(*) AS sessions,
       coalesce(round(avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 9), 0.0) AS recall,
       coalesce(round(avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END), 9), 0.0) AS ndcg
FROM targets t LEFT JOIN preds r ON r.user_session = t.user_session AND r.token_id = t.target"""))
_METRICS = """
SELECT count(*) AS sessions,
       round(avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS recall,
       round(avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END), 9) AS ndcg
FROM targets t LEFT JOIN preds r ON r.user_session = t.user_session AND r.token_id = t.target"""
oracle("trial_metrics", "\nUNION ALL\n".join(
    f"SELECT CAST({t} AS INTEGER) AS trial, CAST({lag} AS INTEGER) AS max_lag, CAST({decay} AS DOUBLE) AS decay, * FROM ({w(_eval_on('val', lag, decay), _METRICS)})"
    for t, (lag, decay) in enumerate(((1, 0.5), (3, 0.5), (20, 0.5), (20, 0.8)))))

# draws: the octaves of 60 ranks without the target's, or of all 60 where the target is a special token
_PLANS = {m: ", ".join(f"({j}, {first}, {size}, {draws}, {sum(d for _, _, d in o[:j])})" for j, (first, size, draws) in enumerate(o) if draws)
          for m, o in ((m, octaves(m, 20)) for m in (59, 60))}
oracle("negative_samples", w(CLICK_ENCODED, f""",
pairs AS (SELECT user_session, pos - 1 AS pos, tok AS target FROM c_tok WHERE pos >= 2),
plan(m, j, first, size, draws, done) AS (SELECT 59, * FROM (VALUES {_PLANS[59]}) UNION ALL SELECT 60, * FROM (VALUES {_PLANS[60]})),
d AS (SELECT p.*, o.*, md5(concat_ws(':', user_session, CAST(pos AS INTEGER), j, 42)) AS h
      FROM pairs p JOIN plan o ON o.m = CASE WHEN target >= 3 THEN 59 ELSE 60 END),
x AS (SELECT *, unnest(range(draws)) AS x FROM d),
r AS (SELECT *, first + (list_extract([{', '.join(map(str, STEPS))}], CAST('0x' || substr(h, 9, 8) AS BIGINT) % 4 + 1) * x
                         + CAST('0x' || substr(h, 1, 8) AS BIGINT)) % size AS r FROM x)
SELECT user_session, CAST(pos AS INTEGER) AS pos, CAST(target AS INTEGER) AS target, CAST(done + x AS INTEGER) AS i,
       CAST(3 + r + CASE WHEN target >= 3 AND r >= target - 3 THEN 1 ELSE 0 END AS INTEGER) AS neg
FROM r"""))
oracle("eval_popularity", w(TEST_EVAL, """
SELECT count(*) AS sessions,
       coalesce(round(avg(CASE WHEN target BETWEEN 3 AND 12 THEN 1.0 ELSE 0.0 END), 9), 0.0) AS recall
FROM targets"""))
oracle("eval_coverage", w(TEST_EVAL, """
SELECT r.recommended_items, v.vocab_items, round(r.recommended_items / v.vocab_items, 9) AS coverage
FROM (SELECT count(DISTINCT token_id) AS recommended_items FROM preds WHERE token_id >= 3) r,
     (SELECT count(*) AS vocab_items FROM vocab) v"""))

RECOMMEND = (MODEL_BASE + _transitions("tr", "true") + _model("model", "tr") + f""",
prior AS (SELECT tok AS dst, count(*) AS prior_n FROM tok WHERE pos >= 2 GROUP BY 1),
sn AS (SELECT user_session, max(pos) AS n, count(DISTINCT product_id) AS d FROM tok GROUP BY 1),
recent AS (SELECT k.user_session, k.tok AS src, s.n - k.pos + 1 AS lag FROM sn s
           JOIN tok k ON k.user_session = s.user_session AND s.n - k.pos + 1 <= {MAX_LAG}),
scores AS (SELECT r.user_session, m.dst, sum(pow(0.5, r.lag - 1) * m.p) AS score
           FROM recent r JOIN model m USING (src) WHERE m.dst >= 3 GROUP BY 1, 2),
popular AS (SELECT dst FROM (SELECT dst, row_number() OVER (ORDER BY prior_n DESC, dst) AS r FROM prior WHERE dst >= 3)
            ),
seen AS (SELECT DISTINCT c.user_session, v.token_id AS dst FROM clicks c JOIN vocab v USING (product_id)),
cand AS (SELECT user_session, dst, max(score) AS score FROM (
           SELECT * FROM scores UNION ALL SELECT s.user_session, p.dst, 0.0 FROM sn s CROSS JOIN popular p)
         GROUP BY 1, 2),
ranked AS (SELECT c.user_session, c.dst, round(c.score, 9) AS score,
                  row_number() OVER (PARTITION BY c.user_session
                                     ORDER BY round(c.score, 9) DESC, coalesce(pr.prior_n, 0) DESC, c.dst) AS rank
           FROM cand c LEFT JOIN prior pr USING (dst)
           WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_session = c.user_session AND x.dst = c.dst)),
recs AS (SELECT r.user_session, CAST(r.rank AS INTEGER) AS rank, v.product_id, r.score
         FROM ranked r JOIN vocab v ON v.token_id = r.dst WHERE r.rank <= 10)""")

oracle("recommend", w(RECOMMEND, "SELECT * FROM recs"))

oracle("recommend_enriched", w(RECOMMEND + "," + BASKETS.strip() + "," + _reduce("baskets", "reduced") + ","
                               + _derive("reduced", "products"), """
SELECT r.user_session, r.rank, r.product_id, p.display_name, p.brand, p.category_top,
       CAST(p.price AS DOUBLE) AS price, p.image_ref
FROM recs r JOIN products p USING (product_id)"""))

# --- recent views, cold start ---------------------------------------------------

oracle("recent_views", w(CLICKS, """,
last AS (SELECT user_session, product_id, max((event_time, event_id)) AS lst FROM clicks GROUP BY 1, 2),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_session ORDER BY lst DESC) AS rk FROM last)
SELECT user_session, CAST(row_number() OVER (PARTITION BY user_session ORDER BY lst) AS INTEGER) AS pos, product_id
FROM kept WHERE rk <= 10"""))

oracle("cold_start_route", w(CLICK_VOCAB, """
SELECT vec_id AS product_id, CASE WHEN vec_id IN (SELECT product_id FROM vocab) THEN 'model' ELSE 'embedding' END AS route
FROM embeddings"""))

oracle("knn_items", w(CLICK_VOCAB, """,
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id NOT IN (SELECT product_id FROM vocab)),
it AS (SELECT vec_id AS product_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.query_id, it.product_id, round(list_dot_product(q.e, it.e), 9) AS similarity
      FROM q, it WHERE q.query_id <> it.product_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, similarity FROM r WHERE rank <= 5"""))
