"""Independent DuckDB SQL for every registered query (the correctness gate).

The text derives the retail views from the driver tables with the same
column mapping as the Spark side (``tillroll.sources.fixture``) but cleans,
joins and aggregates in plain SQL, so a Spark plan bug shows as a mismatch.
Money is rounded to cents in both engines; NULL ordering is spelt out.
"""

from __future__ import annotations

from tillroll.functions.cleaning import MISSING_TOKENS
from tillroll.sources.fixture import duckdb_views

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TOKENS)


def _clean(x: str) -> str:
    return (f"regexp_replace(CASE WHEN {x} IN ({_TOKENS}) THEN NULL ELSE {x} END, "
            r"'^\s+|\s+$', '', 'g')")


def _nullify(x: str) -> str:
    return f"CASE WHEN {x} IN ({_TOKENS}) THEN NULL ELSE {x} END"


def cat(x: str, width: int = 128) -> str:
    return f"coalesce(nullif(trim(substring(cast({x} AS varchar), 1, {width})), ''), 'Unknown')"


_HOUSEHOLDS = f"""households AS (
  SELECT cast(trunc(try_cast(HSHD_NUM AS DOUBLE)) AS BIGINT) AS hshd_num,
    {_clean('L')} AS loyalty_flag,
    {_clean('AGE_RANGE')} AS age_range,
    {_clean('MARITAL')} AS marital_status,
    {_clean('INCOME_RANGE')} AS income_range,
    {_clean('HOMEOWNER')} AS homeowner_desc,
    {_clean('HSHD_COMPOSITION')} AS hshd_composition,
    {_clean('HH_SIZE')} AS hh_size,
    {_clean('CHILDREN')} AS children
  FROM households_raw
  WHERE isfinite(try_cast(HSHD_NUM AS DOUBLE)))"""

_STAR = """star AS (
  SELECT t.*, p.department, p.commodity, p.brand_ty, p.natural_organic_flag,
    h.loyalty_flag, h.age_range, h.marital_status, h.income_range, h.homeowner_desc,
    h.hshd_composition, h.hh_size, h.children
  FROM transactions t
  JOIN products p ON t.product_num = p.product_num
  JOIN households h ON t.hshd_num = h.hshd_num)"""


def with_views(*extra: str) -> str:
    """The shared ``WITH`` list (+ extra CTEs), ready for a final SELECT."""
    return ",\n".join([duckdb_views(), _HOUSEHOLDS, _STAR, *extra]) + "\n"


def top_spend(key_sql: str, name: str, n: int | None) -> str:
    q = f"SELECT {key_sql} AS {name}, round(sum(spend), 2) AS spend FROM star GROUP BY 1"
    if n is None:
        return q + " ORDER BY 1 ASC NULLS FIRST"
    return q + f" ORDER BY 2 DESC, 1 ASC NULLS FIRST LIMIT {n}"


def _num(x: str, typ: str = "BIGINT") -> str:
    d = f"try_cast({_nullify(x)} AS DOUBLE)"
    return f"CASE WHEN isfinite({d}) THEN cast(trunc({d}) AS {typ}) END"


def _dbl(x: str) -> str:
    d = f"try_cast({_nullify(x)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({d}) THEN {d} END"


# strftime layouts of the dates that tillroll.functions.cleaning.parse_date takes
_DATE_LAYOUTS = ("%d-%b-%y", "%d-%b-%Y", "%Y-%m-%d", "%Y-%m-%d %H:%M:%S",
                 "%m/%d/%Y", "%m/%d/%y", "%m/%d/%Y", "%Y/%m/%d")


def _date(x: str) -> str:
    t = _clean(x)
    tries = ", ".join(f"try_strptime({t}, '{f}')" for f in _DATE_LAYOUTS)
    return f"cast(coalesce({tries}) AS DATE)"


_PULL = ("SELECT hshd_num, basket_num, purchase_date AS date, product_num, department, commodity, "
         "spend, units, store_r AS store_region, week_num, year AS year, loyalty_flag, age_range, "
         "marital_status, income_range, homeowner_desc, hshd_composition, hh_size AS hshd_size, "
         "children FROM star WHERE hshd_num = 10 "
         "ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST, 5 NULLS FIRST, "
         "6 NULLS FIRST, 7 NULLS FIRST, 8 NULLS FIRST, 9 NULLS FIRST")

_HH = ("hh AS (SELECT hshd_num, round(sum(spend), 2) AS total_spend, sum(units) AS total_units, "
       "count(DISTINCT basket_num) AS total_baskets, count(DISTINCT week_num) AS active_weeks, "
       "max(week_num) AS last_purchase_week FROM star GROUP BY hshd_num)")

_CHURN = ("churn AS (SELECT hshd_num, last_purchase_week, total_spend, total_baskets, "
          "cast((SELECT max(week_num) FROM star) - last_purchase_week AS INTEGER) "
          "AS weeks_since_last_purchase FROM hh)")

_BS = ("bs AS (SELECT basket_num, count(*) AS n_lines, count(DISTINCT commodity) AS n_commodity, "
       "count(DISTINCT department) AS n_department, round(sum(spend), 2) AS basket_spend "
       "FROM star GROUP BY basket_num)")

_BC = "bc AS (SELECT DISTINCT basket_num, commodity FROM star WHERE commodity IS NOT NULL)"

_PAIRS = ("SELECT a.commodity AS item_1, b.commodity AS item_2, count(*) AS times_bought_together "
          "FROM bc a JOIN bc b ON a.basket_num = b.basket_num AND a.commodity < b.commodity "
          "GROUP BY 1, 2")

_CLV = ("clv AS (SELECT hshd_num, total_spend, total_units, total_baskets, active_weeks, "
        "total_spend * 1.25 AS estimated_future_clv, "
        "cast(round(total_spend * 100) AS BIGINT) AS cents FROM hh WHERE total_baskets > 0)")

_AVG = ("(((cents - ((cents % total_baskets) + total_baskets) % total_baskets) // total_baskets) + "
        "CASE WHEN 2 * (((cents % total_baskets) + total_baskets) % total_baskets) > total_baskets "
        "OR (2 * (((cents % total_baskets) + total_baskets) % total_baskets) = total_baskets AND "
        "((cents - ((cents % total_baskets) + total_baskets) % total_baskets) // total_baskets) % 2 <> 0) "
        "THEN 1 ELSE 0 END) / 100.0")


def _dashboard() -> str:
    """The six series over ``star``."""
    parts = []
    for name, key, n in (
        ("department", "department", 5),
        ("week", "cast(week_num AS varchar)", None),
        ("income", cat("income_range", 256), 12),
        ("children", cat("children"), 10),
        ("brand", cat("brand_ty"), 14),
        ("organic", cat("natural_organic_flag"), 8),
    ):
        order = "week_num ASC NULLS FIRST" if n is None else "spend DESC, label ASC NULLS FIRST"
        sub = (f"SELECT '{name}' AS series, label, spend, "
               f"cast(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM ("
               f"SELECT {key} AS label, min(week_num) AS week_num, round(sum(spend), 2) AS spend "
               f"FROM star GROUP BY 1) s")
        if n is not None:
            sub = f"SELECT * FROM ({sub}) r WHERE rank <= {n}"
        parts.append(sub)
    return "\nUNION ALL\n".join(parts)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    v = with_views()
    q["clean_households"] = v + "SELECT * FROM households"
    totals = (
        "SELECT coalesce(round(sum(spend), 2), 0.0) AS total_spend, "
        "count(DISTINCT basket_num) AS total_transactions, "
        "(count(DISTINCT basket_num) > 0 OR coalesce(round(sum(spend), 2), 0.0) > 0) AS has_data, "
        "format('{:,.2f}', coalesce(round(sum(spend), 2), 0.0)) AS total_spend_text "
        "FROM star")
    q["kpi_totals"] = v + totals
    q["spend_by_department"] = v + top_spend("department", "department", 5)
    q["spend_by_week"] = v + top_spend("week_num", "week_num", None)
    q["spend_by_income"] = v + top_spend(cat("income_range", 256), "cat", 12)
    q["spend_by_children"] = v + top_spend(cat("children"), "cat", 10)
    q["spend_by_brand"] = v + top_spend(cat("brand_ty"), "cat", 14)
    q["spend_by_organic"] = v + top_spend(cat("natural_organic_flag"), "cat", 8)
    q["spend_by_hh_size"] = v + top_spend(cat("hh_size"), "cat", None)
    q["spend_by_store_region"] = v + top_spend(cat("store_r"), "cat", None)
    series = _dashboard()
    q["dashboard_series"] = v + series

    pnum, dept, comm, hnum = '" product_num"', '"DEPARTMENT "', '"Commodity"', '" hshd_num "'
    clean_pr = (
        f"SELECT {_num(pnum)} AS product_num, {_nullify(dept)} AS department, "
        f"{_nullify(comm)} AS commodity, {_nullify('BRAND_TY')} AS brand_ty, "
        f"{_nullify('natural_organic_flag')} AS natural_organic_flag FROM products_raw")
    q["clean_products"] = v + clean_pr
    clean_tx = (
        f"SELECT {_num('BASKET_NUM')} AS basket_num, {_num(hnum)} AS hshd_num, "
        f"{_date('PURCHASE_')} AS purchase_date, {_num('PRODUCT_NUM')} AS product_num, "
        f"{_dbl('spend')} AS spend, {_dbl('UNITS')} AS units, {_nullify('STORE_R')} AS store_r, "
        f"{_num('WEEK_NUM', 'INTEGER')} AS week_num, {_num('YEAR', 'INTEGER')} AS year "
        "FROM transactions_raw")
    q["clean_transactions"] = v + clean_tx
    for table in ("households", "products", "transactions"):
        q[f"clean_{table}_csv"] = q[f"clean_{table}"]
    q["ingest_rejects"] = v + (
        "SELECT * FROM (SELECT 'households' AS source, 'bad_key' AS reason, false AS kept, count(*) AS n_rows "
        "FROM households_raw WHERE NOT coalesce(isfinite(try_cast(HSHD_NUM AS DOUBLE)), false) UNION ALL "
        "SELECT 'transactions', 'bad_date', true, count(*) FROM transactions_raw "
        f"WHERE {_date('PURCHASE_')} IS NULL AND {_nullify('PURCHASE_')} IS NOT NULL) r WHERE n_rows > 0")
    # the star over the raw rows as delivered, cleaned
    delivered = with_views().replace(_STAR, "tx AS (" + clean_tx + "),\npr AS (" + clean_pr + "),\n" + _STAR.replace(
        "FROM transactions t", "FROM tx t").replace("JOIN products p", "JOIN pr p"))
    q["streamed_kpi_totals"] = delivered + totals
    q["maintained_dashboard"] = delivered + series
    q["star_join"] = v + "SELECT * FROM star"
    q["data_pull"] = v + _PULL + " LIMIT 100"
    q["data_pull_sql"] = v + _PULL + " LIMIT 100"
    q["data_pull_top20"] = v + _PULL + " LIMIT 20"
    q["data_pull_sorted"] = v + f"SELECT * FROM ({_PULL} LIMIT 20) p ORDER BY date DESC NULLS LAST"

    vh = with_views(_HH)
    q["household_summary"] = vh + (
        "SELECT hshd_num, total_spend, total_units, total_baskets, active_weeks FROM hh "
        "WHERE total_baskets > 0")
    q["basket_summary"] = with_views(_BS) + "SELECT * FROM bs"
    vc = with_views(_HH, _CHURN)
    risk = "CASE WHEN weeks_since_last_purchase >= 8 THEN 'High Risk' ELSE 'Low Risk' END"
    q["churn_recency"] = vc + f"SELECT *, {risk} AS churn_risk FROM churn"
    q["churn_counts"] = vc + (
        f"SELECT count(*) FILTER (WHERE {risk} = 'High Risk') AS high_risk_count, "
        f"count(*) FILTER (WHERE {risk} = 'Low Risk') AS low_risk_count FROM churn")
    q["churn_top"] = vc + (
        f"SELECT *, {risk} AS churn_risk FROM churn "
        "ORDER BY weeks_since_last_purchase DESC NULLS LAST, hshd_num LIMIT 10")

    vb = with_views(_BC)
    q["basket_items"] = v + (
        "SELECT basket_num, count(DISTINCT commodity) AS n_items, "
        "array_to_string(list_sort(list(DISTINCT commodity)), '; ') AS items "
        "FROM star WHERE commodity IS NOT NULL GROUP BY basket_num")
    q["pair_counts"] = vb + _PAIRS
    q["basket_pairs"] = vb + _PAIRS + " ORDER BY 3 DESC, 1, 2 LIMIT 10"
    q["frequent_pairs"] = vb + _PAIRS + " HAVING count(*) >= 50"
    q["association_rules"] = with_views(
        _BC,
        "tot AS (SELECT count(DISTINCT basket_num) AS total FROM bc)",
        "item AS (SELECT commodity, count(*) AS n_item FROM bc GROUP BY 1)",
        "pair AS (SELECT a.commodity AS x, b.commodity AS y, count(*) AS n FROM bc a JOIN bc b "
        "ON a.basket_num = b.basket_num AND a.commodity <> b.commodity GROUP BY 1, 2)",
    ) + (
        "SELECT x AS antecedent, y AS consequent, n AS n_together, "
        "round(cast(n AS DOUBLE) / total, 6) AS support, "
        "round(cast(n AS DOUBLE) / ix.n_item, 6) AS confidence, "
        "round(cast(n AS DOUBLE) * total / (cast(ix.n_item AS DOUBLE) * iy.n_item), 6) AS lift "
        "FROM pair JOIN item ix ON ix.commodity = x JOIN item iy ON iy.commodity = y CROSS JOIN tot")

    # every set of three and more commodities of every basket, in order
    q["frequent_itemsets"] = with_views(
        _BC, "tot AS (SELECT count(DISTINCT basket_num) AS total FROM bc)",
        "grown AS (SELECT basket_num, commodity AS items, commodity AS last, 1 AS n_items FROM bc UNION ALL "
        "SELECT g.basket_num, g.items || '; ' || b.commodity, b.commodity, g.n_items + 1 FROM grown g "
        "JOIN bc b ON b.basket_num = g.basket_num AND b.commodity > g.last)",
    ).replace("WITH ", "WITH RECURSIVE ", 1) + (
        "SELECT items, n_items, count(*) AS n_baskets FROM grown WHERE n_items >= 3 GROUP BY 1, 2 "
        "HAVING count(*) >= (SELECT greatest(1, ceil(total / 3000.0)) FROM tot)")

    vbs = with_views(_BS)
    q["basket_value_median"] = vbs + "SELECT round(median(basket_spend), 4) AS median_basket_spend FROM bs"
    q["basket_value_label"] = vbs + (
        "SELECT *, cast(basket_spend >= (SELECT median(basket_spend) FROM bs) AS INTEGER) "
        "AS high_value_basket FROM bs")

    q["basket_value_training"] = vbs + (
        "SELECT n_lines, n_commodity, n_department, "
        "cast(basket_spend >= (SELECT median(basket_spend) FROM bs) AS INTEGER) AS high_value_basket, "
        "cast(count(*) AS DOUBLE) AS weight FROM bs GROUP BY 1, 2, 3, 4")
    q["churn_features"] = with_views(
        "cut AS (SELECT max(week_num) - 8 AS cutoff FROM star)",
        "pre AS (SELECT hshd_num, round(sum(spend), 2) AS spend, sum(units) AS units, "
        "cast(count(DISTINCT basket_num) AS DOUBLE) AS baskets, "
        "cast(count(DISTINCT week_num) AS DOUBLE) AS weeks, "
        "cast((SELECT cutoff FROM cut) - max(week_num) AS DOUBLE) AS recency "
        "FROM star WHERE week_num <= (SELECT cutoff FROM cut) GROUP BY hshd_num)",
        "post AS (SELECT DISTINCT hshd_num FROM star WHERE week_num > (SELECT cutoff FROM cut))",
    ) + ("SELECT pre.*, cast(CASE WHEN post.hshd_num IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS churned "
         "FROM pre LEFT JOIN post ON pre.hshd_num = post.hshd_num")

    vclv = with_views(_HH, _CLV)
    q["clv_features"] = vclv + (
        "SELECT hshd_num, total_spend, total_units, total_baskets, active_weeks, "
        f"cast({_AVG} AS DOUBLE) AS avg_basket_value, estimated_future_clv FROM clv")
    # 1.25 x spend in quarter cents, rounded half-even to cents
    clv = ("pred AS (SELECT *, (5 * cents // 4 + CASE WHEN 5 * cents % 4 > 2 OR "
           "(5 * cents % 4 = 2 AND 5 * cents // 4 % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS predicted_clv FROM clv)")
    vpred = with_views(_HH, _CLV, clv)
    top = "SELECT hshd_num, total_spend, estimated_future_clv, predicted_clv, true AS clv_ok FROM pred"
    q["clv_predict"] = vpred + top
    q["clv_top"] = vpred + top + " ORDER BY predicted_clv DESC, hshd_num LIMIT 10"
    q["clv_holdout"] = vclv + (
        "SELECT count(*) FILTER (hshd_num % 5 <> 0) AS n_train, count(*) FILTER (hshd_num % 5 = 0) AS n_test, "
        "cast(0 AS DOUBLE) AS rmse, cast(1 AS DOUBLE) AS r2 FROM clv")
    labelled = ("labelled AS (SELECT *, CASE WHEN basket_spend >= (SELECT median(basket_spend) FROM bs) "
                "THEN 1 ELSE -1 END AS y FROM bs)")
    one = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, cast(count(*) AS DOUBLE) AS w, "
                             f"cast(sum(y) AS DOUBLE) AS s FROM labelled GROUP BY 2"
                             for f in ("n_lines", "n_commodity", "n_department"))
    q["gbt_first_split"] = with_views(
        _BS, labelled, f"v AS ({one})",
        "r AS (SELECT feature, value, lead(value) OVER o AS nxt, sum(w) OVER o AS wl, sum(s) OVER o AS sl, "
        "sum(w) OVER (PARTITION BY feature) AS w, sum(s) OVER (PARTITION BY feature) AS s FROM v "
        "WINDOW o AS (PARTITION BY feature ORDER BY value))",
        "g AS (SELECT feature, (value + nxt) / 2.0 AS cut, cast(wl AS BIGINT) AS n_left, cast(w - wl AS BIGINT) AS n_right, "
        "round((1 - (s / w) * (s / w)) - (wl / w) * (1 - (sl / wl) * (sl / wl)) "
        "- ((w - wl) / w) * (1 - ((s - sl) / (w - wl)) * ((s - sl) / (w - wl))), 9) AS gain FROM r WHERE nxt IS NOT NULL)",
    ) + ("SELECT *, cast(row_number() OVER (ORDER BY gain DESC, feature, cut) AS INTEGER) AS rank_ FROM g")
    q["churn_backtest"] = with_views(
        "hw AS (SELECT DISTINCT hshd_num, week_num FROM star)",
        "cuts AS (SELECT (SELECT max(week_num) FROM star) - 8 * i AS c FROM range(1, 5) t(i))",
        "h AS (SELECT c, hshd_num, c - max(week_num) FILTER (week_num <= c) AS recency, "
        "count(*) FILTER (week_num > c AND week_num <= c + 8) = 0 AS churned FROM hw, cuts GROUP BY 1, 2)",
        "k AS (SELECT * FROM h WHERE recency IS NOT NULL)",
        "p AS (SELECT a.c, sum(CASE WHEN a.recency > b.recency THEN 1.0 WHEN a.recency = b.recency THEN 0.5 ELSE 0 END) AS wins, "
        "count(*) AS pairs FROM k a JOIN k b ON a.c = b.c AND a.churned AND NOT b.churned GROUP BY 1)",
    ) + ("SELECT cast(c AS INTEGER) AS cutoff_week, count(*) AS n_households, count(*) FILTER (churned) AS n_churned, "
         "any_value(round(cast(wins AS DOUBLE) / pairs, 6)) AS auc_recency FROM k LEFT JOIN p USING (c) GROUP BY 1")
    return q
