"""DuckDB SQL with the same results as the core queries."""

from __future__ import annotations

from sluicebox.functions.expressions import DAY_FIRST, MONTH_FIRST, NUMBER, YEARS
from sluicebox.operators.names import BRANDS, CHARACTERS, MISSING_LETTERS

#: The day that stands for today in the date rules.
AS_OF = "2025-12-31"

_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DATES = {"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$": "%Y-%m-%d", MONTH_FIRST: "%m/%d/%Y", DAY_FIRST: "%d-%m-%Y", "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$": "%Y/%m/%d"}


def _strip(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _number(column: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({_strip(column)}, '{NUMBER}') THEN try_cast({_strip(column)} AS DOUBLE) END, 0.0)"


def _quantity(column: str) -> str:
    return f"CASE WHEN greatest({_number(column)}, 0.0) < 9e18 THEN CAST(round_even(greatest({_number(column)}, 0.0), 0) AS BIGINT) ELSE 0 END"


def _discount(column: str) -> str:
    return f"least(greatest({_number(column)}, 0.0), 1.0)"


def _email(column: str) -> str:
    text = f"lower({_strip(column)})"
    return rf"CASE WHEN regexp_matches({text}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN {text} END"


def _date(column: str) -> str:
    shapes = ", ".join(f"CASE WHEN regexp_matches({_strip(column)}, '{shape}') THEN CAST(try_strptime({_strip(column)}, '{form}') AS DATE) END" for shape, form in _DATES.items())
    return f"(SELECT CASE WHEN year(d) BETWEEN {YEARS[0]} AND {YEARS[1]} THEN d END FROM (SELECT coalesce({shapes}) AS d))"


def _revenue(price: str, quantity: str, discount: str) -> str:
    gross = f"CAST(try_cast({price} AS DECIMAL(18,4)) * try_cast({quantity} AS DECIMAL(12,0)) AS DECIMAL(24,4))"
    return f"CAST(round({gross} * CAST(1 - CAST({discount} AS DECIMAL(10,6)) AS DECIMAL(10,6)), 2) AS DOUBLE)"


def _plain(column: str) -> str:
    """Other than ASCII letters stand for one letter each, which edit distances by byte then agree with."""
    return rf"regexp_replace(lower({_strip(column)}), '[^\x00-\x7F]', '?', 'g')"


_FUZZY = f"""fuzzy AS (
    SELECT v AS raw_category, (SELECT category FROM common_categories WHERE levenshtein(p, lower(category)) <= 2 ORDER BY levenshtein(p, lower(category)), category LIMIT 1) AS canonical
    FROM (SELECT DISTINCT lower({_strip('category')}) AS v, {_plain('category')} AS p FROM raw_sales) WHERE v <> '')"""
_REGION = f"""coalesce((SELECT min(canonical) FROM region_map m WHERE m.raw_label = {_strip('r.region')}), (SELECT min(canonical) FROM region_map m WHERE lower(m.raw_label) = lower({_strip('r.region')})))"""
_REGIONS = f"regions AS (SELECT r.region AS raw_region, nullif({_REGION}, 'UNKNOWN') AS canonical FROM (SELECT DISTINCT region FROM raw_sales) r)"

_DUPLICATES = """marked AS (SELECT *, row_number() OVER (PARTITION BY {key}, {chunk} ORDER BY row_id) AS nth, {chunk} AS chunk FROM {rows}),
good AS (SELECT *, min(CASE WHEN nth = 1 AND passes THEN chunk END) OVER (PARTITION BY {key}) AS first_good FROM marked)"""

_JUDGED = f"""WITH {_FUZZY}, {_REGIONS},
typed AS (
    SELECT s.row_id, {_strip('s.order_id')} AS order_id, {_strip('s.product_name')} AS product_name, f.canonical AS category, {_quantity('s.quantity')} AS quantity,
           {_number('s.unit_price')} AS unit_price, {_discount('s.discount_percent')} AS discount_percent, g.canonical AS region, {_date('s.sale_date')} AS day,
           {_email('s.customer_email')} AS customer_email
    FROM raw_sales s LEFT JOIN fuzzy f ON f.raw_category = lower({_strip('s.category')}) LEFT JOIN regions g ON g.raw_region IS NOT DISTINCT FROM s.region),
priced AS (SELECT *, {_revenue('unit_price', 'quantity', 'discount_percent')} AS revenue, order_id = '' OR product_name = '' AS keyless FROM typed),
ruled AS (
    SELECT *, CASE WHEN category IS NULL THEN 'unknown_category' WHEN region IS NULL THEN 'unknown_region'
                   WHEN NOT (unit_price > 0 AND unit_price < 50000) THEN 'invalid_unit_price' WHEN quantity <= 0 THEN 'zero_quantity' WHEN day IS NULL THEN 'invalid_sale_date'
                   WHEN NOT day BETWEEN DATE '{AS_OF}' - INTERVAL 20 YEAR AND DATE '{AS_OF}' + INTERVAL 1 YEAR THEN 'sale_date_out_of_range'
                   WHEN revenue IS NULL OR revenue < 0 OR revenue >= 1000000 THEN 'invalid_calculated_revenue' END AS later,
           CASE WHEN keyless THEN chr(1) || row_id ELSE order_id END AS key
    FROM priced),
passing AS (SELECT *, NOT keyless AND later IS NULL AS passes FROM ruled),
{_DUPLICATES.format(key='key', chunk='(row_id - 1) // 100000', rows='passing')},
judged AS (
    SELECT *, CASE WHEN keyless THEN 'missing_order_id_or_product' WHEN nth > 1 OR coalesce(chunk > first_good, FALSE) THEN 'duplicate_order_id' ELSE later END AS rejection_reason FROM good)"""

_MONEY = "round(CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE), 2)"
_MEAN = "round(CAST(sum(CAST(discount_percent AS DECIMAL(18,6))) AS DOUBLE) / count(discount_percent), 4)"
_TOP_PRODUCTS = f"""totals AS (
    SELECT category, product_name, {_MONEY.format('revenue')} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT order_id) AS order_count
    FROM clean_sales WHERE category IS NOT NULL AND product_name IS NOT NULL GROUP BY ALL),
ranked AS (
    SELECT *, 'revenue' AS metric_type, row_number() OVER (PARTITION BY category ORDER BY total_revenue DESC NULLS LAST, product_name) AS rank FROM totals
    UNION ALL SELECT *, 'units', row_number() OVER (PARTITION BY category ORDER BY total_quantity DESC NULLS LAST, product_name) FROM totals)"""
_TIES = "order_id NULLS FIRST, product_name NULLS FIRST, category NULLS FIRST, region NULLS FIRST, quantity NULLS FIRST, unit_price NULLS FIRST, sale_date NULLS FIRST, customer_email NULLS FIRST"


def _anomalies(most: str, each: int = 5) -> str:
    return f"""WITH revenue_list AS (
        SELECT *, 'high_revenue' AS anomaly_reason, 0 AS list, row_number() OVER (ORDER BY revenue DESC, {_TIES}, discount_percent NULLS FIRST) AS place FROM clean_sales WHERE revenue IS NOT NULL),
    discount_list AS (
        SELECT *, 'high_discount', 1, row_number() OVER (ORDER BY discount_percent DESC, {_TIES}, revenue NULLS FIRST) AS place FROM clean_sales WHERE discount_percent IS NOT NULL),
    both_lists AS (SELECT * FROM revenue_list WHERE place <= {each} UNION ALL SELECT * FROM discount_list WHERE place <= {each}),
    first AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY list, place) AS n FROM both_lists)
    SELECT * FROM (SELECT row_number() OVER (ORDER BY list, place) AS rank, order_id, product_name, category, region, revenue, quantity, unit_price, discount_percent, sale_date, anomaly_reason
                   FROM first WHERE n = 1) WHERE rank <= {most}"""


def _name() -> str:
    text = _strip("product_name")
    for wrong, right in CHARACTERS.items():
        text = f"replace({text}, '{wrong}', '{right}')"
    for wrong, right in MISSING_LETTERS.items():
        text = rf"regexp_replace({text}, '\b{wrong}\b', '{right}', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '([A-Za-z]{{3,}})([0-9])', '\1 \2', 'g'), '[_-]+', ' ', 'g')"
    for brand, written in BRANDS.items():
        text = rf"regexp_replace({text}, '(?i)\b{brand}\b', '{written}', 'g')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_TITLE = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({0}, i - 1, 1), '\\p{{L}}') THEN upper(substr({0}, i, 1)) ELSE substr({0}, i, 1) END), '')"

SQL = {
    "monthly_sales_summary": f"""SELECT strftime(make_timestamp(sale_date * 1000000), '%Y-%m') AS month, {_MONEY.format('revenue')} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_quantity,
        {_MEAN} AS avg_discount_percent, count(DISTINCT order_id) AS order_count FROM clean_sales WHERE sale_date IS NOT NULL GROUP BY 1""",
    "top_products_by_category": f"WITH {_TOP_PRODUCTS} SELECT category, rank, product_name, total_revenue, total_quantity, order_count, metric_type FROM ranked WHERE rank <= 5",
    "region_wise_performance": f"""SELECT region, {_MONEY.format('revenue')} AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT order_id) AS order_count,
        round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT order_id), 2) AS avg_order_value FROM clean_sales WHERE region IS NOT NULL GROUP BY region""",
    "top_categories": f"SELECT category, {_MEAN} AS avg_discount_percent, count(DISTINCT order_id) AS order_count, {_MONEY.format('revenue')} AS total_revenue FROM clean_sales WHERE category IS NOT NULL GROUP BY category",
    "anomaly_records": _anomalies("5"),
    "anomaly_balanced": _anomalies("10"),
    "normalise_string": f"SELECT row_id, {_strip('category')} AS category, {_strip('order_id')} AS order_id FROM raw_sales",
    "email_clean": f"SELECT row_id, {_email('customer_email')} AS customer_email FROM raw_sales",
    "quantity_clean": f"SELECT row_id, {_quantity('quantity')} AS quantity FROM raw_sales",
    "price_clean": f"SELECT row_id, {_number('unit_price')} AS unit_price FROM raw_sales",
    "discount_clip": f"SELECT row_id, {_discount('discount_percent')} AS discount_percent, CASE WHEN {_discount('discount_percent')} > 0.8 THEN 'heavy_discount' END AS anomaly_flag FROM raw_sales",
    "parse_dates": f"""SELECT row_id, CAST(d AS VARCHAR) AS sale_date, CAST(CAST(epoch(d) AS BIGINT) AS VARCHAR) AS epoch,
        CAST(d BETWEEN DATE '{AS_OF}' - INTERVAL 2 YEAR AND DATE '{AS_OF}' AS VARCHAR) AS in_range FROM (SELECT row_id, {_date('sale_date')} AS d FROM raw_sales)""",
    "month_keys": "SELECT strftime(make_timestamp(sale_date * 1000000), '%Y-%m') AS month, min(sale_date) AS first_sale, max(sale_date) AS last_sale, count(*) AS row_count FROM clean_sales GROUP BY 1",
    "revenue": f"""SELECT row_id, coalesce(r, -1.0) AS revenue, coalesce(r >= 0 AND r < 1000000, FALSE) AS valid
        FROM (SELECT row_id, {_revenue(_number('unit_price'), _quantity('quantity'), _discount('discount_percent'))} AS r FROM raw_sales)""",
    "category_exact": f"SELECT row_id, c.category AS canonical FROM raw_sales s LEFT JOIN common_categories c ON lower(c.category) = lower({_strip('s.category')})",
    "category_fuzzy": f"WITH {_FUZZY} SELECT row_id, canonical FROM raw_sales s LEFT JOIN fuzzy ON raw_category = lower({_strip('s.category')})",
    "region_resolve": f"WITH {_REGIONS} SELECT row_id, canonical FROM raw_sales s LEFT JOIN regions ON raw_region IS NOT DISTINCT FROM s.region",
    "region_unmapped": f"WITH {_REGIONS} SELECT coalesce(region, 'UNKNOWN') AS region, count(*) AS row_count FROM raw_sales s LEFT JOIN regions ON raw_region IS NOT DISTINCT FROM s.region WHERE canonical IS NULL GROUP BY 1",
    "dedup_keep_first": "SELECT row_id, row_number() OVER (PARTITION BY order_id, (row_id - 1) // 500 ORDER BY row_id) > 1 AS repeat FROM raw_sales",
    "dedup_chunked": f"""WITH passing AS (SELECT row_id, order_id, {_quantity('quantity')} > 0 AS passes FROM raw_sales),
        {_DUPLICATES.format(key='order_id', chunk='(row_id - 1) // 500', rows='passing')} SELECT row_id, nth > 1 OR coalesce(chunk > first_good, FALSE) AS duplicate FROM good""",
    "dedup_global": f"SELECT arg_min(row_id, row_id) AS row_id, order_id FROM raw_sales WHERE {_quantity('quantity')} > 0 GROUP BY order_id",
    "id_intersection": "SELECT order_id FROM raw_sales WHERE order_id IS NOT NULL INTERSECT SELECT order_id FROM clean_sales",
    "clean_orders": f"""{_JUDGED} SELECT order_id, product_name, category, quantity, unit_price, discount_percent, region, CAST(epoch(day) AS BIGINT) AS sale_date, customer_email, revenue,
        CASE WHEN discount_percent > 0.8 THEN 'heavy_discount' END AS anomaly_flag FROM judged WHERE rejection_reason IS NULL""",
    "reject_orders": f"{_JUDGED} SELECT row_id, rejection_reason FROM judged WHERE rejection_reason IS NOT NULL",
    "clean_funnel": f"{_JUDGED} SELECT count(*) AS rows_in, count(*) FILTER (rejection_reason IS NULL) AS clean_rows, count(rejection_reason) AS rejected_rows, round(count(*) FILTER (rejection_reason IS NULL) * 100.0 / count(*), 2) AS retention_percent FROM judged",
    "reject_reasons": f"{_JUDGED} SELECT rejection_reason AS reason, count(*) AS count, rejection_reason || ' (' || format('{{:,}}', count(*)) || ')' AS label FROM judged WHERE rejection_reason IS NOT NULL GROUP BY 1",
    "category_counts": f"SELECT {_strip('category')} AS value, count(*) AS row_count FROM raw_sales GROUP BY 1",
    "lookup_share": f"""WITH counts AS (SELECT {_strip('category')} AS value, count(*) AS n FROM raw_sales GROUP BY 1),
        kept AS (SELECT lower(value) AS value FROM counts WHERE value <> '' AND n / (SELECT sum(n) FROM counts) >= 0.01)
        SELECT DISTINCT {_TITLE.format('value')} AS label FROM kept""",
    "region_map_build": f"""WITH new AS (SELECT DISTINCT {_strip('region')} AS raw_label FROM raw_sales WHERE {_strip('region')} <> '' AND {_strip('region')} NOT IN (SELECT raw_label FROM region_map)),
        guessed AS (SELECT raw_label, coalesce((SELECT region FROM common_regions WHERE levenshtein({_plain('raw_label')}, lower(region)) <= 2
            ORDER BY levenshtein({_plain('raw_label')}, lower(region)), region LIMIT 1), 'UNKNOWN') AS canonical FROM new)
        SELECT raw_label, arg_min(canonical, p) AS canonical FROM (
            SELECT raw_label, canonical, 0 AS p FROM region_map UNION ALL SELECT raw_label, canonical, 1 FROM guessed UNION ALL SELECT region, region, 2 FROM common_regions) GROUP BY raw_label""",
    "product_category_vote": """WITH counted AS (SELECT product_name, category, count(*) AS n FROM clean_sales WHERE product_name IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
        voted AS (SELECT *, n / sum(n) OVER (PARTITION BY product_name) AS share, row_number() OVER (PARTITION BY product_name ORDER BY n DESC, category) AS place FROM counted)
        SELECT product_name, category, round(share, 4) AS confidence FROM voted WHERE place = 1 AND share > 0.7""",
    "product_name_normalise": f"SELECT row_id, {_name()} AS product_name FROM raw_sales",
    "dataset_summary": """SELECT (SELECT count(*) FROM clean_sales) AS rows, CAST(12 AS BIGINT) AS columns, unnest(['batch_id', 'order_id', 'product_name', 'category', 'quantity', 'unit_price', 'discount_percent', 'region', 'sale_date',
        'customer_email', 'revenue', 'anomaly_flag']) AS column, unnest(['int', 'string', 'string', 'string', 'bigint', 'double', 'double', 'string', 'bigint', 'string', 'double', 'string']) AS type""",
    "category_metric_top15": f"SELECT category, {_MEAN} AS avg_discount_percent FROM clean_sales WHERE category IS NOT NULL GROUP BY category ORDER BY 2 DESC, 1 LIMIT 15",
    "category_metric_sum": "SELECT category, CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) AS total FROM top_products_by_category GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15",
    "category_metric_sum_revenue": "SELECT category, CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) AS total FROM top_products_by_category WHERE metric_type = 'revenue' GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15",
    "default_chart": "SELECT region, CAST(sum(CAST(revenue AS DECIMAL(20,2))) AS DOUBLE) AS total FROM clean_sales GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 NULLS FIRST LIMIT 15",
    "histogram30": """WITH b AS (SELECT min(discount_percent) AS lo, max(discount_percent) AS hi FROM clean_sales),
        placed AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(29, CAST(floor((discount_percent - lo) / (hi - lo) * 30) AS BIGINT)) END AS bin, lo, hi FROM clean_sales, b WHERE discount_percent IS NOT NULL)
        SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * (hi - lo) / 30, 6) AS low, count(*) AS count FROM placed GROUP BY bin, lo, hi""",
    "reason_counts": "SELECT coalesce(anomaly_flag, 'UNKNOWN') AS reason, count(*) AS count, coalesce(anomaly_flag, 'UNKNOWN') || ' (' || format('{:,}', count(*)) || ')' AS label FROM clean_sales GROUP BY anomaly_flag ORDER BY 2 DESC, 1 LIMIT 5",
    "filter_by_reason": "SELECT category, count(*) AS row_count FROM clean_sales WHERE anomaly_flag = 'heavy_discount' GROUP BY category",
    "category_options": "SELECT DISTINCT category FROM clean_sales WHERE category IS NOT NULL",
    "best_sellers_topn": f"WITH {_TOP_PRODUCTS} SELECT category, rank AS place, product_name, total_revenue FROM ranked WHERE metric_type = 'revenue' AND rank <= 3",
    "best_sellers_drilldown": f"WITH {_TOP_PRODUCTS} SELECT category, rank AS place, product_name, total_quantity FROM ranked WHERE metric_type = 'units' AND rank <= 5 AND category = 'Footcare'",
    "preview50": "SELECT row_id, order_id, category, sale_date FROM raw_sales ORDER BY row_id LIMIT 50",
    "labels": f"""SELECT category, {_TITLE.format('lower(category)')} AS titled, category || ' (' || format('{{:,}}', n) || ')' AS label
        FROM (SELECT coalesce(category, 'UNKNOWN') AS category, count(*) AS n FROM clean_sales GROUP BY clean_sales.category)""",
    "csv_round_trip": r"""SELECT nullif(product_name || CASE WHEN row_id % 7 = 0 THEN ',' || chr(10) || '"x" ' ELSE '' END, '') AS product_name, nullif(region, '') AS region, count(*) AS row_count,
        count(nullif(order_id, '')) AS keyed, min(nullif(sale_date, '')) AS first_date FROM raw_sales GROUP BY ALL""",
    "anomaly_view": f"SELECT anomaly_reason AS reason, count(*) AS count, anomaly_reason || ' (' || format('{{:,}}', count(*)) || ')' AS label FROM ({_anomalies('40', 20)}) GROUP BY anomaly_reason",
    "anomaly_view_rows": f"SELECT rank, order_id, anomaly_reason FROM ({_anomalies('40', 20)}) WHERE anomaly_reason = 'high_discount' ORDER BY rank LIMIT 50",
    "reject_view": f"""{_JUDGED} SELECT rejection_reason AS reason, count(*) AS count, rejection_reason || ' (' || format('{{:,}}', count(*)) || ')' AS label
        FROM judged WHERE rejection_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "data_extent": """SELECT count(*) AS rows, count(DISTINCT order_id) AS orders, strftime(make_timestamp(min(sale_date) * 1000000), '%Y-%m-%d') AS first_date,
        strftime(make_timestamp(max(sale_date) * 1000000), '%Y-%m-%d') AS last_date FROM clean_sales""",
    "all_rules": f"""WITH numbered AS (
        SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY order_id NULLS FIRST, product_name NULLS FIRST, category NULLS FIRST, quantity NULLS FIRST, unit_price NULLS FIRST, discount_percent NULLS FIRST,
            region NULLS FIRST, sale_date NULLS FIRST, customer_email NULLS FIRST, revenue NULLS FIRST, anomaly_flag NULLS FIRST) + batch_id * 1000000 AS row_index
        FROM clean_sales WHERE category IS NOT NULL AND region IS NOT NULL),
    given AS (
        SELECT row_index, row_index % 10 AS turn, order_id IS NULL OR {_strip('product_name')} = '' AS keyless,
            CASE row_index % 10 WHEN 1 THEN 0 WHEN 2 THEN 50000 WHEN 3 THEN 49999.99 ELSE coalesce(CAST(CAST(unit_price AS DECIMAL(18,2)) AS DOUBLE), 0) END AS price,
            CASE row_index % 10 WHEN 3 THEN 21 WHEN 4 THEN 0 ELSE greatest(coalesce(quantity, 0), 0) END AS number FROM numbered)
    SELECT row_index, CASE WHEN keyless THEN 'missing_order_id_or_product' WHEN price <= 0 OR price >= 50000 THEN 'invalid_unit_price' WHEN number <= 0 THEN 'zero_quantity'
        WHEN turn = 6 THEN 'invalid_sale_date' WHEN turn = 5 THEN 'sale_date_out_of_range'
        WHEN round(price * number * CASE WHEN turn = 3 THEN 1 ELSE 0.9 END, 2) >= 1000000 THEN 'invalid_calculated_revenue' ELSE 'clean' END AS reason FROM given""",
}
