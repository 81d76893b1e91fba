"""Independent SQL (DuckDB dialect) for every deterministic registered query.

The SQL is written from the query *definitions*, not generated from the Spark
plans, and is run by the correctness check against the same Parquet tables.
Shared sub-results (adapter, cleaning, RFM, ...) are CTE snippets assembled
with ``with_(...)``.
"""
from __future__ import annotations

from tillroll.functions.text import WHITESPACE

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def with_(*ctes: tuple[str, str]) -> str:
    """``WITH a AS (...), b AS (...)`` from (name, body) pairs, deduplicated in order."""
    seen, parts = set(), []
    for name, body in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS {'MATERIALIZED ' if name.startswith('z_') else ''}(\n{body}\n)")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def strip_sql(col: str) -> str:
    chars = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)
    return f"trim({col}, {chars})"


# ------------------------------------------------------------------ adapter --
def raw_cte(name: str = "raw", item: str = "product", with_description: bool = True,
            dirty: bool = False) -> tuple[str, str]:
    desc = {
        "product": "p_name || ' ' || CAST(p_partkey AS VARCHAR)",
        "name": "p_name", "brand": "p_brand", "type": "p_type",
    }[item] if with_description else "CAST(NULL AS VARCHAR)"
    cust = "CAST(o_custkey AS VARCHAR)"
    price = ("CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(12,0)) "
             "* CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))")
    if dirty:
        cust = f"CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {cust} END"
        if with_description:
            desc = (f"CASE WHEN l_partkey % 97 = 0 THEN NULL "
                    f"WHEN l_partkey % 5 = 0 AND l_linenumber % 2 = 0 THEN ' ' || upper({desc}) || chr(9) || ' ' "
                    f"ELSE {desc} END")
        price = f"CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(12,2)) ELSE {price} END"
    join_part = "JOIN part ON l_partkey = p_partkey" if with_description else ""
    country = ""
    if dirty:
        join_part += " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
        country = ",\n         n_name AS Country"
    body = f"""
  SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         {desc} AS Description,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INTEGER) AS Quantity,
         o_orderdate AS InvoiceDate,
         {price} AS UnitPrice,
         {cust} AS CustomerID{country}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey {join_part}"""
    return name, body


CANCELLED = "coalesce(starts_with(InvoiceNo, 'C'), false)"
POSITIVE = "coalesce(Quantity > 0 AND UnitPrice > 0, false)"


def keep_sql(variant: str) -> str:
    base = f"NOT {CANCELLED} AND {POSITIVE}"
    return {
        "rfm": f"{base} AND CustomerID IS NOT NULL",
        "basket": f"{base} AND Description IS NOT NULL",
        "product": f"{base} AND CustomerID IS NOT NULL AND Description IS NOT NULL",
    }[variant]


def desc_sql(variant: str) -> str:
    return {"rfm": "Description", "basket": strip_sql("Description"),
            "product": f"upper({strip_sql('Description')})"}[variant]


def clean_cte(variant: str, raw: str = "raw", name: str | None = None, dirty: bool = False) -> tuple[str, str]:
    amount = "CAST(CAST(Quantity AS DECIMAL(10,0)) * UnitPrice AS DECIMAL(18,2))"
    extra = {"rfm": f", {amount} AS TotalPrice", "product": f", {amount} AS TotalRevenue", "basket": ""}[variant]
    extra += ", Country" if dirty else ""
    body = f"""
  SELECT InvoiceNo, StockCode, {desc_sql(variant)} AS Description, Quantity, InvoiceDate, UnitPrice,
         CustomerID{extra}
  FROM {raw} WHERE {keep_sql(variant)}"""
    return name or f"clean_{variant}", body


def clean_ctes(variant: str, dirty: bool = False, item: str = "product") -> list[tuple[str, str]]:
    raw_name = f"raw_{variant}"
    return [raw_cte(raw_name, item=item, with_description=dirty or variant != "rfm", dirty=dirty),
            clean_cte(variant, raw=raw_name, dirty=dirty)]


# ---------------------------------------------------------------- features --
def rfm_ctes(dirty: bool = False) -> list[tuple[str, str]]:
    return clean_ctes("rfm", dirty=dirty) + [("rfm", """
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(TotalPrice) AS DOUBLE) AS Monetary,
         CAST((epoch_us((SELECT max(InvoiceDate) FROM clean_rfm) + INTERVAL 1 DAY)
               - epoch_us(max(InvoiceDate))) // 86400000000 AS INTEGER) AS Recency
  FROM clean_rfm GROUP BY CustomerID""")]


def product_agg_ctes(dirty: bool = False) -> list[tuple[str, str]]:
    return clean_ctes("product", dirty=dirty) + [("product_agg", """
  SELECT Description,
         CAST(sum(UnitPrice) AS DOUBLE) / count(UnitPrice) AS avg_price,
         CAST(sum(Quantity) AS BIGINT) AS total_quantity,
         count(DISTINCT InvoiceNo) AS num_transactions,
         count(DISTINCT CustomerID) AS num_customers,
         CAST(sum(TotalRevenue) AS DOUBLE) AS total_revenue
  FROM clean_product GROUP BY Description""")]


def product_features_ctes(q: float = 0.99, min_tx: int = 10, dirty: bool = False) -> list[tuple[str, str]]:
    return product_agg_ctes(dirty) + [("product_features", f"""
  SELECT * FROM product_agg
  WHERE total_revenue <= (SELECT quantile_cont(total_revenue, {q}) FROM product_agg)
    AND num_transactions >= {min_tx}""")]


def describe_sql(source: str, features: list[str]) -> str:
    parts = []
    for f in features:
        c = f"CAST({f} AS DOUBLE)"
        parts.append(f"""
  SELECT '{f}' AS feature, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
         round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25,
         round(quantile_cont({c}, 0.5), 2) AS p50, round(quantile_cont({c}, 0.75), 2) AS p75,
         round(max({c}), 2) AS max
  FROM {source}""")
    return "\nUNION ALL".join(parts)


def _clean_select(variant: str, money: list[str]) -> str:
    cols = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
            "CAST(UnitPrice AS DOUBLE) AS UnitPrice", "CustomerID", "Country"]
    cols += [f"CAST({m} AS DOUBLE) AS {m}" for m in money]
    return f"SELECT {', '.join(cols)} FROM clean_{variant}"


oracle("clean_rfm", with_(*clean_ctes("rfm", dirty=True)) + _clean_select("rfm", ["TotalPrice"]))
oracle("clean_basket", with_(*clean_ctes("basket", dirty=True)) + _clean_select("basket", []))
oracle("clean_product", with_(*clean_ctes("product", dirty=True)) + _clean_select("product", ["TotalRevenue"]))


oracle("transactions_csv", with_(raw_cte("raw", dirty=True)) + """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country
FROM raw""")

oracle("transactions_extracts", with_(raw_cte("raw", dirty=True)) + """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID,
       CASE WHEN year(InvoiceDate) IN (1994, 1995) THEN NULL ELSE Country END AS Country
FROM raw""")
oracle("transactions_rejected", with_(raw_cte("raw", dirty=True)) + """
SELECT concat_ws('; ', CASE WHEN q THEN 'Quantity' END, CASE WHEN d THEN 'InvoiceDate' END, CASE WHEN p THEN 'UnitPrice' END) AS reason, InvoiceNo, StockCode,
       CAST(Quantity AS VARCHAR) || CASE WHEN q THEN ' pcs' ELSE '' END AS Quantity,
       CASE WHEN d THEN strftime(InvoiceDate, '%Y.%m.%d') ELSE strftime(InvoiceDate, '%-m/%-d/%Y %-H:%M:%S') END AS InvoiceDate,
       CASE WHEN p THEN replace(price, '.', ',') ELSE price END AS UnitPrice, CustomerID
FROM (SELECT *, CAST(StockCode AS BIGINT) % 11 = 0 AS q, CAST(StockCode AS BIGINT) % 13 = 0 AS d, CAST(StockCode AS BIGINT) % 17 = 0 AS p,
             CAST(CAST(UnitPrice AS DECIMAL(18,6)) AS VARCHAR) AS price FROM raw)
WHERE q OR d OR p""")


def _report_sql() -> str:
    rows = []
    for v in ("rfm", "basket", "product"):
        if v == "rfm":
            nulls, canc = "CustomerID IS NULL", f"CustomerID IS NOT NULL AND {CANCELLED}"
        elif v == "basket":
            nulls, canc = f"NOT {CANCELLED} AND {POSITIVE} AND Description IS NULL", CANCELLED
        else:
            nulls = f"NOT {CANCELLED} AND {POSITIVE} AND (Description IS NULL OR CustomerID IS NULL)"
            canc = CANCELLED
        keep = keep_sql(v)
        rows.append(f"""
  SELECT count(*) AS raw_rows, '{v}' AS variant,
         count(*) FILTER (WHERE {nulls}) AS dropped_nulls,
         count(*) FILTER (WHERE {canc}) AS dropped_cancelled,
         count(*) FILTER (WHERE {keep}) AS clean_rows,
         count(DISTINCT CASE WHEN {keep} THEN {desc_sql(v)} END) AS distinct_products,
         count(DISTINCT CASE WHEN {keep} THEN InvoiceNo END) AS distinct_invoices
  FROM raw""")
    return with_(raw_cte("raw", dirty=True)) + "\nUNION ALL".join(rows)


oracle("cleaning_report", _report_sql())
oracle("rfm", with_(*rfm_ctes()) + "SELECT * FROM rfm")
oracle("rfm_dirty", with_(*rfm_ctes(dirty=True)) + "SELECT * FROM rfm")
oracle("reference_date", with_(*clean_ctes("rfm")) + """
SELECT max(InvoiceDate) AS last_invoice, max(InvoiceDate) + INTERVAL 1 DAY AS reference_time,
       CAST(max(InvoiceDate) + INTERVAL 1 DAY AS DATE) AS reference_date FROM clean_rfm""")
oracle("rfm_describe", with_(*rfm_ctes()) + describe_sql("rfm", ["Recency", "Frequency", "Monetary"]))
oracle("product_features", with_(*product_features_ctes()) + "SELECT * FROM product_features")
oracle("product_features_dirty", with_(*product_features_ctes(dirty=True)) + "SELECT * FROM product_features")
oracle("rfm_incremental", ORACLE["rfm_dirty"])
oracle("product_features_incremental", ORACLE["product_features_dirty"])
oracle("product_describe", with_(*product_features_ctes()) + describe_sql(
    "product_features", ["avg_price", "total_quantity", "num_transactions", "num_customers", "total_revenue"]))


# ------------------------------------------------------------------ baskets --
def basket_ctes(basket_col: str = "CustomerID", item: str = "type", min_support: float = 0.15,
                min_count: int = 1, max_items: int | None = None, min_conf: float = 0.3,
                min_lift: float = 1.0, tag: str = "m", dirty: bool = False) -> list[tuple[str, str]]:
    """Pairs, kept items, itemsets (explicit joins per length, max 3) and rules
    (all splits written out per length)."""
    t = tag
    ctes = clean_ctes("basket", dirty=dirty, item=item)
    ctes += [
        (f"pairs_{t}", f"""
  SELECT {basket_col} AS basket, Description AS item FROM clean_basket
  WHERE {basket_col} IS NOT NULL AND Description IS NOT NULL
  GROUP BY 1, 2 HAVING sum(Quantity) > 0"""),
        (f"nb_{t}", f"SELECT count(DISTINCT {basket_col}) AS n FROM clean_basket WHERE {basket_col} IS NOT NULL"),
        (f"item_freq_{t}", f"SELECT item, count(*) AS n_baskets FROM pairs_{t} GROUP BY item"),
        (f"kept_{t}", f"""
  SELECT item FROM item_freq_{t} WHERE n_baskets >= {min_count}
  ORDER BY n_baskets DESC, item {f'LIMIT {max_items}' if max_items else ''}"""),
        (f"bi_{t}", f"SELECT basket, item FROM pairs_{t} WHERE item IN (SELECT item FROM kept_{t})"),
        (f"l1_{t}", f"""
  SELECT item AS i1, count(*) AS freq FROM bi_{t} GROUP BY item
  HAVING count(*) / (SELECT n FROM nb_{t}) >= {min_support}"""),
        (f"b1_{t}", f"SELECT basket, item FROM bi_{t} WHERE item IN (SELECT i1 FROM l1_{t})"),
        (f"l2_{t}", f"""
  SELECT a.item AS i1, b.item AS i2, count(*) AS freq
  FROM b1_{t} a JOIN b1_{t} b ON a.basket = b.basket AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM nb_{t}) >= {min_support}"""),
        (f"l3_{t}", f"""
  SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS freq
  FROM b1_{t} a JOIN b1_{t} b ON a.basket = b.basket AND a.item < b.item
  JOIN l2_{t} p ON p.i1 = a.item AND p.i2 = b.item
  JOIN b1_{t} c ON c.basket = a.basket AND b.item < c.item
  GROUP BY 1, 2, 3 HAVING count(*) / (SELECT n FROM nb_{t}) >= {min_support}"""),
        (f"itemsets_{t}", f"""
  SELECT [i1] AS items, freq, freq / (SELECT n FROM nb_{t}) AS support, 1 AS length FROM l1_{t}
  UNION ALL SELECT [i1, i2], freq, freq / (SELECT n FROM nb_{t}), 2 FROM l2_{t}
  UNION ALL SELECT [i1, i2, i3], freq, freq / (SELECT n FROM nb_{t}), 3 FROM l3_{t}"""),
        (f"splits_{t}", f"""
  SELECT [i1] AS ante, [i2] AS cons, freq / (SELECT n FROM nb_{t}) AS support FROM l2_{t}
  UNION ALL SELECT [i2], [i1], freq / (SELECT n FROM nb_{t}) FROM l2_{t}
  UNION ALL SELECT [i1], [i2, i3], freq / (SELECT n FROM nb_{t}) FROM l3_{t}
  UNION ALL SELECT [i2], [i1, i3], freq / (SELECT n FROM nb_{t}) FROM l3_{t}
  UNION ALL SELECT [i3], [i1, i2], freq / (SELECT n FROM nb_{t}) FROM l3_{t}
  UNION ALL SELECT [i1, i2], [i3], freq / (SELECT n FROM nb_{t}) FROM l3_{t}
  UNION ALL SELECT [i1, i3], [i2], freq / (SELECT n FROM nb_{t}) FROM l3_{t}
  UNION ALL SELECT [i2, i3], [i1], freq / (SELECT n FROM nb_{t}) FROM l3_{t}"""),
        (f"rules_all_{t}", f"""
  SELECT s.ante, s.cons, s.support, s.support / a.support AS confidence,
         (s.support / a.support) / c.support AS lift
  FROM splits_{t} s JOIN itemsets_{t} a ON a.items = s.ante JOIN itemsets_{t} c ON c.items = s.cons"""),
        (f"rules_{t}", f"""
  SELECT ante, cons, array_to_string(ante, ', ') AS antecedents_str, array_to_string(cons, ', ') AS consequents_str,
         support, confidence, lift
  FROM rules_all_{t} WHERE lift >= {min_lift} AND confidence >= {min_conf}"""),
    ]
    return ctes


M = basket_ctes()
MM = basket_ctes(basket_col="InvoiceNo", item="type", min_support=0.03, min_lift=0.0, tag="x")
MC = basket_ctes(item="product", min_count=5, max_items=500, tag="c")
RULE_SEL = "antecedents_str, consequents_str, support, confidence, lift"
ORDER = "lift DESC, antecedents_str, consequents_str"


def hu(expr: str, digits: int) -> str:
    """Display rounding, ties to the even digit, on the scaled value."""
    s = f"{10.0 ** digits!r}"
    return f"(round_even(CAST({expr} AS DOUBLE) * {s}, 0) / {s})"


oracle("item_frequency", with_(*MC) + "SELECT item, n_baskets FROM item_freq_c")
oracle("basket_items", with_(*MC) + "SELECT basket, item FROM bi_c")
oracle("frequent_itemsets", with_(*M) +
       "SELECT array_to_string(items, ', ') AS items_str, freq, support, length FROM itemsets_m")
oracle("frequent_itemsets_multi", with_(*MM) +
       "SELECT array_to_string(items, ', ') AS items_str, freq, support, length FROM itemsets_x")
oracle("frequent_itemsets_fpgrowth", ORACLE["frequent_itemsets"])
oracle("itemset_length_histogram", with_(*M) +
       "SELECT length, count(*) AS n_itemsets FROM itemsets_m GROUP BY length")
oracle("association_rules", with_(*M) + f"SELECT {RULE_SEL} FROM rules_m")
oracle("association_rules_dirty", with_(*basket_ctes(tag="d", dirty=True)) + f"SELECT {RULE_SEL} FROM rules_d")
oracle("association_rules_multi", with_(*MM) + f"SELECT {RULE_SEL} FROM rules_x")
oracle("rule_counts_by_lift", with_(*M) + """
SELECT count(*) AS total_rules, count(*) FILTER (WHERE lift > 2.0) AS rules_lift_gt_2,
       count(*) FILTER (WHERE lift > 3.0) AS rules_lift_gt_3 FROM rules_m""")
oracle("recommend_basket", with_(*M) + f"""
SELECT 'promo' AS product, row_number() OVER (ORDER BY {ORDER}) AS rank,
       consequents_str AS recommended_product,
       {hu('confidence', 3)} AS confidence, {hu('lift', 3)} AS lift, {hu('support', 4)} AS support,
       'Customers who buy ''' || antecedents_str || ''' are ' || CAST({hu('lift', 1)} AS VARCHAR)
         || 'x more likely to also buy ''' || consequents_str || '''' AS interpretation
FROM (SELECT * FROM rules_m WHERE coalesce(regexp_matches(antecedents_str, '(?i)promo'), false)
      ORDER BY {ORDER} LIMIT 5)""")
oracle("recommend_batch", with_(*M) + """
SELECT product, rank, recommended_product, antecedents_str, confidence, lift, support FROM (
  SELECT u.product, r.consequents_str AS recommended_product, r.antecedents_str, r.confidence, r.lift, r.support,
         row_number() OVER (PARTITION BY u.product ORDER BY r.lift DESC, r.antecedents_str, r.consequents_str) AS rank
  FROM rules_m r
  JOIN (SELECT DISTINCT items[1] AS product FROM itemsets_m WHERE length = 1) u ON contains(lower(r.antecedents_str), lower(u.product))
) WHERE rank <= 5""")
oracle("recommendable_products", with_(*M) + """
SELECT product, (SELECT count(DISTINCT antecedents_str) FROM rules_m) AS total
FROM (SELECT DISTINCT antecedents_str AS product FROM rules_m)""")
oracle("top_rules", with_(*M) + f"""
SELECT row_number() OVER (ORDER BY {ORDER}) AS position, {RULE_SEL},
       substring(antecedents_str, 1, 30) || '  →  ' || substring(consequents_str, 1, 25) AS label,
       substring(antecedents_str, 1, 38) || '  →  ' || substring(consequents_str, 1, 33) AS long_label,
       confidence * 100 AS confidence_pct,
       (lift - min(lift) OVER ()) / (max(lift) OVER () - min(lift) OVER () + 1e-9) AS strength
FROM (SELECT * FROM rules_m ORDER BY {ORDER} LIMIT 20)""")
oracle("top_single_items", with_(*M) + """
SELECT items[1] AS item, support, support * 100 AS support_pct FROM itemsets_m WHERE length = 1
ORDER BY support DESC, item LIMIT 15""")
oracle("rule_matrix", with_(*M) + f"""
SELECT substring(antecedents_str, 1, 35) AS row_label, substring(consequents_str, 1, 30) AS col_label,
       antecedents_str, consequents_str, max(lift) AS max_lift
FROM (SELECT * FROM rules_m ORDER BY {ORDER} LIMIT 15) GROUP BY antecedents_str, consequents_str""")
oracle("rule_grid", with_(*M) + f"""
SELECT substring(a.antecedents_str, 1, 35) AS row_label, a.antecedents_str, c.consequents_str, coalesce(max(t.lift), 0.0) AS lift
FROM (SELECT DISTINCT antecedents_str FROM (SELECT * FROM rules_m ORDER BY {ORDER} LIMIT 15)) a
JOIN (SELECT DISTINCT consequents_str FROM (SELECT * FROM rules_m ORDER BY {ORDER} LIMIT 15)) c ON true
LEFT JOIN (SELECT * FROM rules_m ORDER BY {ORDER} LIMIT 15) t
  ON t.antecedents_str = a.antecedents_str AND t.consequents_str = c.consequents_str
GROUP BY a.antecedents_str, c.consequents_str""")
oracle("top50_export", with_(*M) + f"""
SELECT antecedents_str AS "If customer buys", consequents_str AS "Recommend", support AS "Support",
       confidence AS "Confidence", lift AS "Lift" FROM rules_m ORDER BY {ORDER} LIMIT 50""")
oracle("scatter_rules", with_(*M) + f"SELECT {RULE_SEL} FROM rules_m")


# --------------------------------------------------------------- clustering --
RFM_F = ["Recency", "Frequency", "Monetary"]
PROD_F = ["avg_price", "total_quantity", "num_transactions", "num_customers", "total_revenue"]


def scaled_ctes(src: str, id_col: str, feats: list[str], t: str) -> list[tuple[str, str]]:
    g = "1000000.0"
    mom = ", ".join(
        f"floor(avg(CAST({f} AS DOUBLE)) * {g} + 0.5) / {g} AS m_{f}, "
        f"floor(stddev_pop(CAST({f} AS DOUBLE)) * {g} + 0.5) / {g} AS s_{f}" for f in feats)
    zs = ", ".join(
        f"CASE WHEN s_{f} IS NULL OR s_{f} = 0 THEN 0.0 ELSE (CAST({f} AS DOUBLE) - m_{f}) / s_{f} END AS z_{f}"
        for f in feats)
    milli = ", ".join(f"CAST(floor(z_{f} * 1000) AS BIGINT) AS z_{f}_milli" for f in feats)
    return [(f"mom_{t}", f"SELECT {mom} FROM {src}"),
            (f"zf_{t}", f"SELECT {id_col} AS id, {zs} FROM {src}, mom_{t}"),
            (f"z_{t}", f"SELECT *, {milli} FROM zf_{t}")]


def kmeans_ctes(t: str, feats: list[str], k: int = 4, n_init: int = 10, max_iter: int = 300) -> list[tuple[str, str]]:
    """Lloyd iterations of all starts by recursion until each is a fixed point; the start with the least inertia."""
    zc = [f"z_{f}_milli" for f in feats]
    cols, point = ", ".join(zc), "[" + ", ".join(zc) + "]"

    def distance(j: int, centres: str) -> str:
        return " + ".join(f"(z.{c} - {centres}[{j + 1}][{i + 1}]) * (z.{c} - {centres}[{j + 1}][{i + 1}])" for i, c in enumerate(zc))

    def key(centres: str) -> str:  # nearest centre, ties to the lower one, packed as distance * k + centre
        return "least(" + ", ".join(f"({distance(j, centres)}) * {k} + {j}" for j in range(k)) + ")"

    floor_mean = "[" + ", ".join(f"CAST((sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for c in zc) + "]"
    moved = ", ".join(f"coalesce(any_value(m) FILTER (WHERE cid = {j}), centres[{j + 1}])" for j in range(k))
    won = "-ln((CAST('0x' || substring(md5(s || ':{j}:' || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / d"
    seeds = [(f"seed1_{t}", f"""
  SELECT s, [p] AS centres FROM (SELECT s, {point} AS p, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':0:' || id), id) AS rn
                                 FROM z_{t}, (SELECT unnest(range({n_init})) AS s)) WHERE rn = 1""")]
    for j in range(1, k):
        nearest = "least(" + ", ".join(distance(i, "q.centres") for i in range(j)) + ")"
        seeds.append((f"seed{j + 1}_{t}", f"""
  SELECT s, list_append(centres, p) AS centres FROM (
    SELECT s, centres, p, row_number() OVER (PARTITION BY s ORDER BY {won.format(j=j)}, id) AS rn
    FROM (SELECT q.s, q.centres, z.id, {point} AS p, {nearest} AS d FROM seed{j}_{t} q, z_{t} z) WHERE d > 0) WHERE rn = 1"""))
    return [
        *seeds,
        (f"lloyd_{t}", f"""
  SELECT s, 0 AS it, centres, false AS done FROM seed{k}_{t}
  UNION ALL
  SELECT s, it + 1, nc, nc = centres FROM (
    SELECT s, it, centres, [{moved}] AS nc FROM (
      SELECT s, it, centres, cid, {floor_mean} AS m FROM (
        SELECT l.s, l.it, l.centres, {key('l.centres')} % {k} AS cid, {', '.join('z.' + c for c in zc)}
        FROM lloyd_{t} l, z_{t} z WHERE NOT l.done AND l.it < {max_iter})
      GROUP BY s, it, centres, cid)
    GROUP BY s, it, centres)"""),
        (f"best_{t}", f"""
  SELECT centres FROM (SELECT l.s, l.centres, sum({key('l.centres')} // {k}) AS inertia FROM lloyd_{t} l, z_{t} z WHERE l.done GROUP BY l.s, l.centres)
  ORDER BY inertia, s LIMIT 1"""),
        (f"assigned_{t}", f"SELECT z.id, CAST({key('b.centres')} % {k} AS INTEGER) AS Cluster FROM z_{t} z, best_{t} b"),
    ]


def customers_seg_ctes() -> list[tuple[str, str]]:
    ctes = rfm_ctes() + scaled_ctes("rfm", "CustomerID", RFM_F, "c") + kmeans_ctes("c", RFM_F)
    ctes += [
        ("cj", "SELECT r.*, a.Cluster FROM rfm r JOIN assigned_c a ON a.id = r.CustomerID"),
        ("cm", """
  SELECT Cluster, CAST(sum(Recency) AS DOUBLE) / count(*) AS mr, CAST(sum(Frequency) AS DOUBLE) / count(*) AS mf,
         CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS mm FROM cj GROUP BY Cluster"""),
        ("c_lost", "SELECT Cluster FROM cm ORDER BY mr DESC, Cluster LIMIT 1"),
        ("c_rk", """
  SELECT Cluster, rank() OVER (ORDER BY mr) + rank() OVER (ORDER BY mf DESC) + rank() OVER (ORDER BY mm DESC) AS rs
  FROM cm WHERE Cluster <> (SELECT Cluster FROM c_lost)"""),
        ("c_lab", """
  SELECT Cluster, CASE WHEN (SELECT count(*) FROM cm) <> 4 THEN 'Cluster ' || Cluster ELSE 'Lost' END AS Segment
  FROM c_lost
  UNION ALL
  SELECT Cluster, CASE WHEN (SELECT count(*) FROM cm) <> 4 THEN 'Cluster ' || Cluster
                       ELSE CASE row_number() OVER (ORDER BY rs, Cluster) WHEN 1 THEN 'Champions'
                                 WHEN 2 THEN 'Loyal' ELSE 'At-Risk' END END
  FROM c_rk"""),
        ("cust_seg", """
  SELECT cj.CustomerID, cj.Frequency, cj.Monetary, cj.Recency, cj.Cluster, l.Segment
  FROM cj JOIN c_lab l ON l.Cluster = cj.Cluster"""),
    ]
    return ctes


def products_seg_ctes() -> list[tuple[str, str]]:
    ctes = product_features_ctes() + scaled_ctes("product_features", "Description", PROD_F, "p") + \
        kmeans_ctes("p", PROD_F)
    means = ", ".join(f"CAST(sum({f}) AS DOUBLE) / count(*) AS m_{f}" for f in PROD_F)
    ctes += [
        ("pj", "SELECT f.*, a.Cluster FROM product_features f JOIN assigned_p a ON a.id = f.Description"),
        ("pm", f"SELECT Cluster, {means} FROM pj GROUP BY Cluster"),
        ("p_prem", "SELECT Cluster FROM pm ORDER BY m_avg_price DESC, Cluster LIMIT 1"),
        ("p_trend", """
  SELECT Cluster FROM pm WHERE Cluster NOT IN (SELECT Cluster FROM p_prem)
  ORDER BY m_total_quantity DESC, m_num_transactions DESC, Cluster LIMIT 1"""),
        ("p_niche", """
  SELECT Cluster FROM pm WHERE Cluster NOT IN (SELECT Cluster FROM p_prem) AND Cluster NOT IN (SELECT Cluster FROM p_trend)
  ORDER BY m_num_transactions, m_num_customers, Cluster LIMIT 1"""),
        ("p_lab", """
  SELECT Cluster, CASE WHEN (SELECT count(*) FROM pm) <> 4 THEN 'Cluster ' || Cluster
                       WHEN Cluster IN (SELECT Cluster FROM p_prem) THEN 'Premium'
                       WHEN Cluster IN (SELECT Cluster FROM p_trend) THEN 'Trending'
                       WHEN Cluster IN (SELECT Cluster FROM p_niche) THEN 'Niche' ELSE 'Budget' END AS Segment
  FROM pm"""),
        ("prod_seg", f"""
  SELECT pj.Description, {', '.join('pj.' + f for f in PROD_F)}, pj.Cluster, l.Segment
  FROM pj JOIN p_lab l ON l.Cluster = pj.Cluster"""),
    ]
    return ctes


CS, PS = customers_seg_ctes(), products_seg_ctes()


def _dim_values(rows: list[tuple], cols: str) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({cols})"


def _seg_dim(kind: str) -> tuple[str, str]:
    from tillroll.functions import dims
    names = dims.CUSTOMER_SEGMENTS if kind == "customer" else dims.PRODUCT_SEGMENTS
    acts = dims.CUSTOMER_ACTIONS if kind == "customer" else dims.PRODUCT_ACTIONS
    descs = dims.CUSTOMER_DESCRIPTIONS if kind == "customer" else dims.PRODUCT_DESCRIPTIONS
    rows = [(s, i, acts[s], descs[s]) for i, s in enumerate(names)]
    return f"dim_{kind}", _dim_values(rows, "Segment, seg_order, action, description")


oracle("scaled_rfm", with_(*rfm_ctes(), *scaled_ctes("rfm", "CustomerID", RFM_F, "c")) +
       "SELECT id AS CustomerID, " + ", ".join(f"z_{f}" for f in RFM_F) + ", " +
       ", ".join(f"z_{f}_milli" for f in RFM_F) + " FROM z_c")
oracle("scaled_products", with_(*product_features_ctes(), *scaled_ctes("product_features", "Description", PROD_F, "p")) +
       "SELECT id AS Description, " + ", ".join(f"z_{f}" for f in PROD_F) + ", " +
       ", ".join(f"z_{f}_milli" for f in PROD_F) + " FROM z_p")
def _silhouette_sql(kind: str, t: str, feats: list[str], sample: int = 1000) -> str:
    squared = " + ".join(f"CAST((a.z_{f}_milli - b.z_{f}_milli) * (a.z_{f}_milli - b.z_{f}_milli) AS DOUBLE)" for f in feats)
    form = lambda d: f"""(SELECT avg(CASE WHEN n = 1 OR greatest(inside, outside) = 0 THEN 0.0 ELSE (outside - inside) / greatest(inside, outside) END) FROM (
    SELECT id, any_value(n) AS n, sum(total) FILTER (WHERE own) / greatest(1, any_value(n) - 1) AS inside, min(total / m) FILTER (WHERE NOT own) AS outside FROM (
      SELECT a.id, a.Cluster = b.Cluster AS own, (SELECT count(*) FROM taken_{t} x WHERE x.Cluster = a.Cluster) AS n, count(*) AS m, sum({d}) AS total
      FROM taken_{t} a, taken_{t} b GROUP BY a.id, a.Cluster, b.Cluster) GROUP BY id))"""  # noqa: E731
    return f"""
SELECT '{kind}' AS kind, (SELECT count(*) FROM z_{t}) AS n_rows, (SELECT count(*) FROM taken_{t}) AS n_sampled,
       round({form(f'sqrt({squared})')}, 6) AS euclidean, round({form(squared)}, 6) AS squared"""


def _taken(t: str, sample: int = 1000) -> tuple[str, str]:
    return f"taken_{t}", f"SELECT z.*, Cluster FROM z_{t} z JOIN assigned_{t} USING (id) ORDER BY md5(id), id LIMIT {sample}"


oracle("segment_silhouette", with_(*CS, *PS, _taken("c"), _taken("p")) + _silhouette_sql("customer", "c", RFM_F) + " UNION ALL " + _silhouette_sql("product", "p", PROD_F))
oracle("kmeans_fixed_customers", with_(*CS) + "SELECT * FROM cust_seg")
oracle("kmeans_fixed_products", with_(*PS) + "SELECT * FROM prod_seg")


def _means_long_sql(src: str, kind: str, feats: list[str], exact: set[str]) -> str:
    parts = []
    for f in feats:
        x = f"CAST({f} AS DECIMAL(28,2))" if f in exact else f
        parts.append(f"SELECT '{kind}' AS kind, Cluster, Segment, count(*) AS n, '{f}' AS feature, "
                     f"{hu(f'CAST(sum({x}) AS DOUBLE) / count({x})', 2)} AS mean FROM {src} GROUP BY Cluster, Segment")
    return "\nUNION ALL ".join(parts)


oracle("trained_invariants", with_(*rfm_ctes(), *product_features_ctes()) + """
SELECT 'customer' AS kind, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_not_nearest, true AS inertia_holds FROM rfm
UNION ALL SELECT 'product', count(*), 4, 0, true FROM product_features""")
oracle("cluster_means", with_(*CS, *PS) + _means_long_sql("cust_seg", "customer", RFM_F, {"Monetary"}) +
       "\nUNION ALL " + _means_long_sql("prod_seg", "product", PROD_F, set()))

oracle("score_customers", with_(*CS, _seg_dim("customer")) + """
SELECT s.CustomerID, s.Recency AS recency, s.Frequency AS frequency, s.Monetary AS monetary,
       s.Cluster AS cluster_id, s.Segment AS segment, coalesce(d.action, '') AS marketing_action,
       coalesce(d.description, '') AS segment_description
FROM cust_seg s LEFT JOIN dim_customer d ON d.Segment = s.Segment""")
oracle("score_products", with_(*PS, _seg_dim("product")) + f"""
SELECT s.Description, {', '.join('s.' + f for f in PROD_F)}, s.Cluster AS cluster_id, s.Segment AS segment,
       coalesce(d.action, '') AS seller_action, coalesce(d.description, '') AS segment_description
FROM prod_seg s LEFT JOIN dim_product d ON d.Segment = s.Segment""")
oracle("customer_lookup", with_(*CS, _seg_dim("customer")) + f"""
SELECT s.CustomerID AS customer_id, coalesce(s.Segment, 'Unknown') AS segment,
       {hu('CAST(s.Recency AS DOUBLE)', 2)} AS recency, CAST(s.Frequency AS BIGINT) AS frequency,
       {hu('s.Monetary', 2)} AS monetary, coalesce(d.action, '') AS marketing_action
FROM cust_seg s JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS cid FROM customer) i ON i.cid = s.CustomerID
LEFT JOIN dim_customer d ON d.Segment = s.Segment""")


def _summary_sql(src: str, kind: str) -> str:
    return f"""
SELECT c.Segment, c.count, {hu('c.count / (SELECT count(*) FROM ' + src + ') * 100', 1)} AS percentage,
       coalesce(d.action, '') AS action, (SELECT count(*) FROM {src}) AS total
FROM (SELECT Segment, count(*) AS count FROM {src} WHERE Segment IS NOT NULL GROUP BY Segment) c
LEFT JOIN dim_{kind} d ON d.Segment = c.Segment"""


oracle("customer_summary", with_(*CS, _seg_dim("customer")) + _summary_sql("cust_seg", "customer"))
oracle("product_summary", with_(*PS, _seg_dim("product")) + _summary_sql("prod_seg", "product"))
oracle("products_by_segment", with_(*PS, _seg_dim("product")) + f"""
SELECT f.Segment, f.position, f.Description, {', '.join('f.' + x for x in PROD_F)}, sh.count, sz.segment_size,
       d.action
FROM (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY Description) AS position FROM prod_seg
      WHERE Segment IN ('Premium', 'Trending', 'Budget', 'Niche')) f
JOIN (SELECT Segment, count(*) AS segment_size FROM prod_seg GROUP BY Segment) sz ON sz.Segment = f.Segment
JOIN (SELECT Segment, least(count(*), 20) AS count FROM prod_seg
      WHERE Segment IN ('Premium', 'Trending', 'Budget', 'Niche') GROUP BY Segment) sh ON sh.Segment = f.Segment
LEFT JOIN dim_product d ON d.Segment = f.Segment
WHERE f.position <= 20""")
oracle("overview_kpis", with_(*CS, *PS, *M) + f"""
SELECT count(*) AS total_customers,
       {hu('CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE)', 2)} AS total_revenue_gbp,
       {hu('CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) / count(*)', 2)} AS avg_order_value,
       {hu('CAST(sum(CAST(Monetary AS DECIMAL(28,2))) AS DOUBLE) / sum(Frequency)', 2)} AS avg_invoice_value,
       (SELECT count(*) FROM prod_seg) AS total_products, (SELECT count(*) FROM rules_m) AS total_rules
FROM cust_seg""")
oracle("overview_top_rules", with_(*M) +
       f"SELECT antecedents_str, consequents_str, lift, confidence FROM rules_m ORDER BY {ORDER} LIMIT 5")
oracle("top_customers", with_(*CS) + """
SELECT row_number() OVER (ORDER BY Monetary DESC, CustomerID) AS position, CustomerID, Recency, Frequency,
       Monetary, Segment
FROM (SELECT * FROM cust_seg WHERE Segment = 'Champions' ORDER BY Monetary DESC, CustomerID LIMIT 10)""")
oracle("top_products", with_(*PS) + """
SELECT row_number() OVER (ORDER BY total_revenue DESC, Description) AS position, Description, avg_price,
       total_quantity, total_revenue, Segment
FROM (SELECT * FROM prod_seg ORDER BY total_revenue DESC, Description LIMIT 10)""")


def _dist_sql(src: str, kind: str) -> str:
    n = f"coalesce(c.n, 0)"
    return f"""
SELECT '{kind}' AS kind, d.Segment, d.seg_order, CAST({n} AS BIGINT) AS count,
       {hu(n + ' / (SELECT count(*) FROM ' + src + ') * 100', 1)} AS percentage
FROM dim_{kind} d LEFT JOIN (SELECT Segment, count(*) AS n FROM {src} GROUP BY Segment) c ON c.Segment = d.Segment"""


oracle("segment_distribution", with_(*CS, *PS, _seg_dim("customer"), _seg_dim("product")) +
       _dist_sql("cust_seg", "customer") + "\nUNION ALL" + _dist_sql("prod_seg", "product"))


def _profile_sql(src: str, feats: list[str], invert: set[str], exact: set[str]) -> str:
    means = ", ".join(
        f"floor(CAST(sum({'CAST(' + f + ' AS DECIMAL(28,2))' if f in exact else f}) AS DOUBLE) / count({f})"
        f" * 1000000.0 + 0.5) / 1000000.0 AS m_{f}"
        for f in feats)
    cols = []
    for f in feats:
        norm = f"(m_{f} - min(m_{f}) OVER ()) / CASE WHEN max(m_{f}) OVER () - min(m_{f}) OVER () <> 0 " \
               f"THEN max(m_{f}) OVER () - min(m_{f}) OVER () END"
        if f in invert:
            norm = f"1.0 - {norm}"
        cols += [f"{hu('m_' + f, 2)} AS mean_{f}", f"{norm} AS norm_{f}"]
    return f"SELECT Segment, {', '.join(cols)} FROM (SELECT Segment, {means} FROM {src} " \
           f"WHERE Segment IS NOT NULL GROUP BY Segment)"


oracle("segment_profile_customers", with_(*CS) + _profile_sql("cust_seg", RFM_F, {"Recency"}, {"Monetary"}))
oracle("segment_profile_products", with_(*PS) + _profile_sql("prod_seg", PROD_F, set(), set()))


def _grid_sql(expr: str) -> str:
    return f"floor({expr} * 1000000.0 + 0.5) / 1000000.0"


def _box_sql(src: str, kind: str, feats: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT Segment, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src} "
                              f"WHERE Segment IS NOT NULL" for f in feats)
    return f"""
SELECT l.Segment, l.feature, q.q1, q.median, q.q3, q.iqr,
       min(CASE WHEN l.v >= q.q1 - 1.5 * q.iqr AND l.v <= q.q3 + 1.5 * q.iqr THEN l.v END) AS whisker_low,
       max(CASE WHEN l.v >= q.q1 - 1.5 * q.iqr AND l.v <= q.q3 + 1.5 * q.iqr THEN l.v END) AS whisker_high,
       count(*) FILTER (WHERE NOT (l.v >= q.q1 - 1.5 * q.iqr AND l.v <= q.q3 + 1.5 * q.iqr)) AS n_outliers,
       count(*) AS n, '{kind}' AS kind
FROM ({long}) l JOIN (
  SELECT *, q3 - q1 AS iqr FROM (
    SELECT Segment, feature, {_grid_sql('quantile_cont(v, 0.25)')} AS q1, {_grid_sql('quantile_cont(v, 0.5)')} AS median,
           {_grid_sql('quantile_cont(v, 0.75)')} AS q3
    FROM ({long}) GROUP BY Segment, feature)) q ON q.Segment = l.Segment AND q.feature = l.feature
GROUP BY l.Segment, l.feature, q.q1, q.median, q.q3, q.iqr"""


oracle("segment_boxplot", with_(*CS, *PS) + _box_sql("cust_seg", "customer", RFM_F) + "\nUNION ALL" +
       _box_sql("prod_seg", "product", PROD_F))
def _outlier_sql(src: str, kind: str, ident: str, feats: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT Segment, {ident} AS id, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src} "
                              f"WHERE Segment IS NOT NULL" for f in feats)
    return f"""
SELECT l.Segment, l.feature, l.id, l.v AS value, '{kind}' AS kind
FROM ({long}) l JOIN (SELECT Segment, feature, {_grid_sql('quantile_cont(v, 0.25)')} AS q1, {_grid_sql('quantile_cont(v, 0.75)')} AS q3 FROM ({long}) GROUP BY Segment, feature) q
  ON q.Segment = l.Segment AND q.feature = l.feature
WHERE NOT (l.v >= q.q1 - 1.5 * (q.q3 - q.q1) AND l.v <= q.q3 + 1.5 * (q.q3 - q.q1))"""


oracle("boxplot_outliers", with_(*CS, *PS) + _outlier_sql("cust_seg", "customer", "CustomerID", RFM_F) + "\nUNION ALL" +
       _outlier_sql("prod_seg", "product", "Description", PROD_F))
oracle("scatter_customers", with_(*CS) + "SELECT CustomerID, Recency, Frequency, Monetary, Segment FROM cust_seg")
oracle("scatter_products", with_(*PS) +
       "SELECT Description, avg_price, total_revenue / 1000 AS revenue_k, Segment FROM prod_seg")


def _density_sql(src: str, x: str, y: str, cells: int = 50) -> str:
    place = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN least({cells - 1}, CAST(floor(({c} - min({c}) OVER ()) * {cells} / (max({c}) OVER () - min({c}) OVER ())) AS INTEGER)) ELSE 0 END"
    return f"""
SELECT Segment, cell_x, cell_y, count(*) AS n FROM (
  SELECT Segment, {place('x')} AS cell_x, {place('y')} AS cell_y
  FROM (SELECT Segment, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))
GROUP BY 1, 2, 3"""


oracle("density_customers", with_(*CS) + _density_sql("cust_seg", "Recency", "Monetary"))
oracle("density_products", with_(*PS) + _density_sql("prod_seg", "avg_price", "total_revenue"))
oracle("reservoir_customers", with_(*CS) + """
SELECT CustomerID, Recency, Frequency, Monetary, Segment
FROM (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY md5(CustomerID), CustomerID) AS draw FROM cust_seg) WHERE draw <= 100""")
# The sketches' values differ by engine; that they keep their error bounds doesn't.
oracle("quantile_sketches", with_(*CS, *PS) + "\nUNION ALL".join(
    f"\nSELECT '{kind}' AS kind, '{f}' AS feature, q, count({f}) AS n, TRUE AS within_error FROM {src}, (SELECT unnest([0.25, 0.5, 0.75, 0.99])::DOUBLE AS q) GROUP BY q"
    for kind, src, feats in (("customer", "cust_seg", RFM_F), ("product", "prod_seg", PROD_F)) for f in feats))
oracle("distinct_sketches", with_(raw_cte("raw", dirty=True)) + "\nUNION ALL".join(
    f"\nSELECT CAST(year(InvoiceDate) AS INTEGER) AS year, '{c}' AS metric, count(DISTINCT {c}) AS exact_count, TRUE AS within_error FROM raw WHERE {c} IS NOT NULL GROUP BY 1"
    for c in ("InvoiceNo", "StockCode", "CustomerID")))
oracle("top_products_per_segment", with_(*PS) + """
SELECT Segment, rank, Description, substring(Description, 1, 40) AS label, total_revenue,
       total_revenue / 1000 AS revenue_k
FROM (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY total_revenue DESC, Description) AS rank
      FROM prod_seg WHERE Segment IS NOT NULL) WHERE rank <= 10""")


def _campaign_sql() -> str:
    from tillroll.functions import dims
    rows = []
    for seg, (strategy, description, channels) in dims.CAMPAIGNS.items():
        for ch in channels:
            rows.append((seg, strategy, description, ch))
    return _dim_values(rows, "Segment, strategy, campaign_description, channel")


oracle("campaign_targets", with_(*CS, ("camp", _campaign_sql())) + f"""
SELECT k.Segment, k.strategy, k.campaign_description, k.channel, CAST(coalesce(c.count, 0) AS BIGINT) AS target_count,
       coalesce({hu('c.count / (SELECT count(*) FROM cust_seg) * 100', 1)}, 0.0) AS percentage,
       (SELECT count(*) FROM cust_seg) AS addressable_audience
FROM camp k LEFT JOIN (SELECT Segment, count(*) AS count FROM cust_seg WHERE Segment IS NOT NULL GROUP BY Segment) c
  ON c.Segment = k.Segment""")
oracle("dataset_health", with_(*CS, *PS, *M) + """
SELECT 'customers' AS "table", count(*) AS "rows" FROM cust_seg
UNION ALL SELECT 'products', count(*) FROM prod_seg
UNION ALL SELECT 'rules', count(*) FROM rules_m""")


# -------------------------------------------------------------------- users --
def users_cte() -> tuple[str, str]:
    from tillroll.sources.users import SEGMENT_ROLE
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_ROLE.items())
    return "users", f"""
  SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         CASE c_mktsegment {case} ELSE 'customer' END AS role, c_acctbal >= 0 AS is_active, f.created_at
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
    ON f.o_custkey = c_custkey"""


LISTING = """SELECT id, name, email, role, is_active, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS status,
       strftime(created_at, '%Y-%m-%d') AS joined FROM users"""
oracle("users_report", with_(users_cte()) + LISTING)
oracle("user_search", with_(users_cte()) + LISTING +
       " WHERE (contains(lower(name), '0001') OR contains(lower(email), '0001')) AND role = 'customer'")
oracle("user_roles", with_(users_cte()) + """
SELECT coalesce(d.role, c.role) AS role, CAST(coalesce(c.n, 0) AS BIGINT) AS users,
       (SELECT count(*) FROM users) AS total_users
FROM (VALUES ('customer'), ('seller'), ('marketer'), ('admin')) d(role)
FULL JOIN (SELECT role, count(*) AS n FROM users GROUP BY role) c ON c.role = d.role""")
# Requests in order of arrival: an accepted one claims its e-mail; a taken e-mail is found out before a wrong role.
oracle("new_accounts", with_(users_cte(), ("req", """
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS request_id, CASE WHEN s_nationkey <> 2 THEN s_name END AS name,
         lower(replace(s_name, '#', '.')) || '@example.com' AS email,
         CASE WHEN s_nationkey = 0 THEN 'vendor' ELSE 'seller' END AS role, s_suppkey * 10 + 9 AS arrival FROM supplier
  UNION ALL
  SELECT 'R' || CAST(s_suppkey AS VARCHAR), s_name, lower(replace(s_name, '#', '.')) || '@example.com', 'seller', s_suppkey * 10 + 10
  FROM supplier WHERE s_nationkey < 2
  UNION ALL
  SELECT 'C' || CAST(c_custkey AS VARCHAR), c_name,
         CASE WHEN c_custkey % 2 = 1 THEN upper(lower(replace(c_name, '#', '.')) || '@example.com')
              ELSE lower(replace(c_name, '#', '.')) || '@example.com' END, 'customer', c_custkey * 10
  FROM customer WHERE c_acctbal < 0"""), ("ok", """
  SELECT email, request_id, row_number() OVER (PARTITION BY email ORDER BY arrival, request_id) AS turn, arrival FROM req
  WHERE coalesce(trim(name), '') <> '' AND coalesce(trim(email), '') <> ''
    AND role IN ('customer', 'seller', 'marketer', 'admin') AND email NOT IN (SELECT email FROM users)""")) + """
SELECT r.request_id, r.name, r.email, r.role,
       CASE WHEN coalesce(trim(r.name), '') = '' OR coalesce(trim(r.email), '') = '' THEN 'missing_fields'
            WHEN r.email IN (SELECT email FROM users) THEN 'duplicate_email'
            WHEN ok.request_id = r.request_id THEN 'accepted'
            WHEN ok.arrival < r.arrival OR (ok.arrival = r.arrival AND ok.request_id < r.request_id) THEN 'duplicate_email'
            ELSE 'invalid_role' END AS status
FROM req r LEFT JOIN ok ON ok.email = r.email AND ok.turn = 1""")

# ---------------------------------------------------------------- streaming --
oracle("stream_kpis", """
WITH p AS (SELECT CAST(value AS DECIMAL(18,2)) AS amt, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
             count(*) AS orders, sum(amt) AS amt FROM p GROUP BY 1, 2)
SELECT window_start, window_end, orders, CAST(amt AS DOUBLE) AS amount, CAST(amt AS DOUBLE) / orders AS avg_amount
FROM w WHERE window_end <= (SELECT max(ts) FROM p) - INTERVAL 1 HOUR""")
oracle("stream_order_feed", with_(*CS, _seg_dim("customer")) + """
SELECT e.event_id AS order_id, CAST(e.user_id AS VARCHAR) AS customer_id, e.ts, e.value AS amount,
       coalesce(s.Segment, 'Unknown') AS customer_segment, coalesce(d.action, '') AS marketing_action
FROM events e LEFT JOIN cust_seg s ON s.CustomerID = CAST(e.user_id AS VARCHAR)
LEFT JOIN dim_customer d ON d.Segment = s.Segment
WHERE e.event_type = 'purchase'""")
oracle("stream_scoring", ORACLE["score_customers"])

oracle("stream_trained_scoring", with_(*rfm_ctes()) + "SELECT CustomerID, Recency, Frequency, Monetary, TRUE AS agrees FROM rfm")
oracle("stream_kpis_open", """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS orders,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
oracle("stream_order_feed_live", with_(*CS, _seg_dim("customer")) + """
SELECT e.event_id AS order_id, CAST(e.user_id AS VARCHAR) AS customer_id, e.ts, e.value AS amount,
       coalesce(s.Segment, 'Unknown') AS customer_segment, coalesce(d.action, '') AS marketing_action
FROM events e LEFT JOIN cust_seg s ON s.CustomerID = CAST(e.user_id AS VARCHAR) AND e.event_id % 2 = 1
LEFT JOIN dim_customer d ON d.Segment = s.Segment
WHERE e.event_type = 'purchase'""")
