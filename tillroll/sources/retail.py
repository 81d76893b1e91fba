"""Transaction sources (S1, S2) and the adapter from the supplied star schema.

``retail_raw`` yields the retail line schema

    InvoiceNo string, StockCode string, Description string, Quantity int,
    InvoiceDate timestamp_ntz, UnitPrice decimal(18,6), CustomerID string, Country string

from ``lineitem ⋈ orders [⋈ part] [⋈ customer ⋈ nation]``.  Only the joins whose
columns a job needs are planned (an inner join cannot be pruned by Catalyst).
The lineitem/orders join is a shuffle join on the order key; part and customer
grow with the data, so Spark's own size estimate (AQE) decides whether they are
broadcast; nation (25 rows by definition) is always broadcast.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.text import header_name
from tillroll.session import input_bytes, tasks_for
from tillroll.sources.tables import table

RETAIL_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("UnitPrice", T.DecimalType(18, 6)),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Country", T.StringType()),
])

# Source header -> canonical name (both spellings of the customer column exist).
RENAME = {"Invoice": "InvoiceNo", "Price": "UnitPrice", "CustomerID": "CustomerID"}

ITEM_GRAINS = ("product", "name", "brand", "type")


def canonical_names(columns: list[str]) -> list[str]:
    """Strip + drop spaces in headers, then rename those that have another canonical name."""
    return [RENAME.get(header_name(c), header_name(c)) for c in columns]


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_names(df.columns))


#: Name of the column with the text of a line whose number of fields is wrong.
_LINE = "_line"


def _extract(spark: SparkSession, path: str, fmt: str, cells: bool) -> DataFrame:
    """One extract under canonical names; CSV cells are texts.  With ``cells`` also ``file`` and the text of malformed lines.

    Columns go by this extract's own header.  All files of a CSV extract must share it, which Spark checks as it reads them."""
    if fmt == "csv":
        header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _LINE]])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", _LINE).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
        raw, header = raw.withColumn(_LINE, F.lit(None).cast("string")), raw.columns
    names = canonical_names(header)
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{path}: several columns named {', '.join(twice)}")
    known = [F.col(f"`{h}`").alias(n) for h, n in zip(header, names) if n in RETAIL_SCHEMA.fieldNames()]
    return raw.select(*known, *([F.col("_metadata.file_name").alias("file"), _LINE] if cells else []))


def _extracts(spark: SparkSession, paths: str | list[str], fmt: str, cells: bool) -> DataFrame:
    own = [_extract(spark, p, fmt, cells) for p in ([paths] if isinstance(paths, str) else paths)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    return out.withColumns({f.name: F.lit(None).cast("string") for f in RETAIL_SCHEMA.fields if f.name not in out.columns})


def read_transactions(spark: SparkSession, paths: str | list[str], fmt: str = "csv",
                      timestamp_format: str | None = None) -> DataFrame:
    """One or several yearly extracts as one table, typed to RETAIL_SCHEMA; a cell that has no value of its type is an error.

    Each extract (a file or a folder of files with one header) is read by its own header, so extracts may differ in the order, spelling
    and number of columns; what one lacks is null.  CSV is read as text, then cast — the customer
    id stays text even when it looks numeric.  ``timestamp_format`` is a Spark
    pattern such as ``M/d/yyyy H:mm``; without one ISO texts are expected.
    """
    raw = _extracts(spark, paths, fmt, cells=False)
    cols = []
    for f in RETAIL_SCHEMA.fields:
        c = F.col(f.name)
        if f.name == "InvoiceDate" and fmt == "csv":
            c = F.to_timestamp_ntz(c, F.lit(timestamp_format)) if timestamp_format else F.to_timestamp_ntz(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def read_extracts(spark: SparkSession, paths: str | list[str], fmt: str = "csv",
                  timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 for extracts with bad rows: (rows typed to RETAIL_SCHEMA, rejected rows).

    A row is rejected if a cell holds a text that is no value of its column's type, or if its line has too few or too
    many fields.  ``rejected`` has the cells as texts, ``reason`` (columns in the schema's order, joined by ``; ``), the ``file`` and,
    of a malformed line, its whole text as ``line``.  An empty cell is null and no fault.  Each row is in exactly one of the two;
    both are scans of the extracts: write them once if several jobs follow.
    """
    raw = _extracts(spark, paths, fmt, cells=True)
    typed, faults = {}, [F.when(F.col(_LINE).isNotNull(), F.lit("fields"))]
    for f in RETAIL_SCHEMA.fields:
        c = F.col(f.name)
        if f.name == "InvoiceDate" and timestamp_format and fmt == "csv":
            # the parser of wall clock times raises, so it only sees what the other one could read
            value = F.when(F.try_to_timestamp(c, F.lit(timestamp_format)).isNotNull(), F.to_timestamp_ntz(c, F.lit(timestamp_format)))
        else:
            value = c.try_cast(f.dataType)
        typed[f.name] = value
        if not isinstance(f.dataType, T.StringType):
            faults.append(F.when(c.isNotNull() & value.isNull(), F.lit(f.name)))
    checked = raw.withColumn("reason", F.concat_ws("; ", *faults))
    rows = checked.filter("reason = ''").select(*[typed[f.name].alias(f.name) for f in RETAIL_SCHEMA.fields])
    rejected = checked.filter("reason <> ''").select("file", "reason", *[F.col(f.name).cast("string").alias(f.name) for f in RETAIL_SCHEMA.fields], F.col(_LINE).alias("line"))
    return rows, rejected


def _unit_price(price: Column, qty: Column) -> Column:
    """Line price per unit in whole cents (integer cents keep engines equal), in the schema's scale."""
    cents = F.floor(price * F.lit(100) / qty).cast("decimal(12,0)")
    return (cents * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,6)")


def retail_raw(spark: SparkSession, sf_dir: str, item: str = "product", *,
               with_description: bool = True, with_country: bool = False,
               dirty: bool = False) -> DataFrame:
    """Retail lines from the supplied tables.

    * returned lines (``l_returnflag = 'R'``) become cancelled lines: invoice
      prefixed with "C" and negative quantity;
    * ``item`` picks the product grain: ``product`` = "<p_name> <p_partkey>",
      ``name`` = p_name, ``brand`` = p_brand, ``type`` = p_type;
    * ``dirty=True`` derives the cleaning edge cases from every row by fixed
      rules (null customer on every tenth order, null description for every
      97th part, zero price on line 7, padded upper-case descriptions on even
      lines of every fifth part) so the cleaning operators have work to do.
    """
    if item not in ITEM_GRAINS:
        raise ValueError(f"item must be one of {ITEM_GRAINS}")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber",
               "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    tasks = tasks_for(input_bytes(li) + input_bytes(orders))
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):  # else a task sorts more lines the more there are
        li, orders = li.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    df = li.join(orders, li.l_orderkey == orders.o_orderkey)

    if with_description:
        part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
        df = df.join(part, df.l_partkey == part.p_partkey)
        desc = {
            "product": F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")),
            "name": F.col("p_name"),
            "brand": F.col("p_brand"),
            "type": F.col("p_type"),
        }[item]
    else:
        desc = F.lit(None).cast("string")

    if with_country:
        cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
        nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
        df = (df.join(cust, df.o_custkey == cust.c_custkey)
                .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey))
        country = F.col("n_name")
    else:
        country = F.lit(None).cast("string")

    returned = F.col("l_returnflag") == "R"
    invoice = F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")),
                       F.col("l_orderkey").cast("string"))
    qty = F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int")
    price = _unit_price(F.col("l_extendedprice"), F.col("l_quantity"))
    customer = F.col("o_custkey").cast("string")

    if dirty:
        customer = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(customer)
        if with_description:
            desc = (F.when(F.col("l_partkey") % 97 == 0, F.lit(None))
                     .when((F.col("l_partkey") % 5 == 0) & (F.col("l_linenumber") % 2 == 0),
                           F.concat(F.lit(" "), F.upper(desc), F.lit("\t ")))
                     .otherwise(desc))
        price = F.when(F.col("l_linenumber") == 7, F.lit(0).cast("decimal(18,6)")).otherwise(price)

    return df.select(
        invoice.alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        desc.alias("Description"),
        qty.alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        price.alias("UnitPrice"),
        customer.alias("CustomerID"),
        country.alias("Country"),
    )
