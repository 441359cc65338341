"""The raw order export layout and its CSV scan (A1).

``raw_orders_frame`` renders ``order_lines`` in the layout of the raw export
(readable headers, some with trailing blanks; dates as ``M/d/yyyy H:mm``
text).  It only changes names and formats; the cleaning job does the work.
``write_raw_csv`` / ``scan_orders_csv`` round-trip it through latin-1 CSV in
the shared checkpoint folder.  The scan goes by the file's own header, in
whatever order and with whatever extra columns it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from tidewater.session import scratch_path

# --- fixed values: raw export headers (trailing blanks are part of the names)
RAW_LAYOUT = [
    ("Type", "order_type", StringType()),
    ("Days for shipping (real)     ", "actual_days", IntegerType()),
    ("Days for shipment (scheduled)", "scheduled_days", IntegerType()),
    ("Late_delivery_risk           ", "late_risk", IntegerType()),
    ("Category Name", "category", StringType()),
    ("Customer Segment", "customer_segment", StringType()),
    ("Department Name", "department", StringType()),
    ("Market", "market", StringType()),
    ("Order City", "city", StringType()),
    ("Order Country", "country", StringType()),
    ("order date (DateOrders)", None, StringType()),
    ("Order Id", "order_id", LongType()),
    ("Order Item Discount Rate     ", "discount_rate", DoubleType()),
    ("Order Item Id", "line_no", IntegerType()),
    ("Order Item Quantity", "quantity", DoubleType()),
    ("Order Item Total  ", "order_value", DoubleType()),
    ("Order Region", "order_region", StringType()),
    ("Product Card Id", "product_id", LongType()),
    ("Product Name", "product_name", StringType()),
    ("Shipping date (DateOrders)   ", None, StringType()),
    ("Shipping Mode", "shipping_mode", StringType()),
]
RAW_DATE_FORMAT = "M/d/yyyy H:mm"
# --- fixed values: all headers of the export in their documented order
RAW_HEADERS = [
    "Type", "Days for shipping (real)     ", "Days for shipment (scheduled)", "Benefit per order",
    "Sales per customer", "Delivery Status", "Late_delivery_risk           ", "Category Id", "Category Name",
    "Customer City", "Customer Country", "Customer Email", "Customer Fname", "Customer Id", "Customer Lname",
    "Customer Password", "Customer Segment", "Customer State", "Customer Street", "Customer Zipcode",
    "Department Id", "Department Name", "Latitude", "Longitude", "Market", "Order City", "Order Country",
    "Order Customer Id", "order date (DateOrders)", "Order Id", "Order Item Cardprod Id", "Order Item Discount",
    "Order Item Discount Rate     ", "Order Item Id", "Order Item Product Price     ", "Order Item Profit Ratio",
    "Order Item Quantity", "Sales", "Order Item Total  ", "Order Profit Per Order", "Order Region", "Order State",
    "Order Status", "Product Card Id", "Product Category Id", "Product Description", "Product Image",
    "Product Name", "Product Price", "Product Status", "Shipping date (DateOrders)   ", "Shipping Mode",
]
RAW_SOURCE_COLUMNS = [src for _, src, _ in RAW_LAYOUT if src] + ["order_date", "shipping_date"]
RAW_TYPES = {name.strip(): t for name, _, t in RAW_LAYOUT}


def raw_orders_frame(order_lines: DataFrame) -> DataFrame:
    """Order lines under all headers of the export; a header without a source column holds its own name."""
    known = {name: src for name, src, _ in RAW_LAYOUT}
    cols = []
    for name in RAW_HEADERS:
        if name.startswith("order date"):
            c = F.date_format(F.col("order_date").cast("timestamp_ntz"), RAW_DATE_FORMAT)
        elif name.startswith("Shipping date"):
            c = F.date_format(F.col("shipping_date"), RAW_DATE_FORMAT)
        else:
            c = F.col(known[name]) if name in known else F.lit(name.strip())
        cols.append(c.alias(name))
    return order_lines.select(*cols)


def write_raw_csv(raw: DataFrame, path: str | None = None) -> str:
    path = path or scratch_path(raw.sparkSession, "raw-orders-csv")
    # as text a line of the export takes some 650 bytes, most of them alike in all lines
    (raw.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1")
     .option("compression", "gzip").csv(path))
    return path


def scan_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV, latin-1; types by header name, text for headers not known, no inference pass over the data.

    The schema follows the header's own order, and files of one folder whose header differs are an error.
    """
    read = spark.read.option("header", True).option("encoding", "ISO-8859-1")
    header = read.csv(path).columns
    schema = StructType([StructField(c, RAW_TYPES.get(c.strip(), StringType()), True) for c in header])
    return read.schema(schema).option("enforceSchema", False).csv(path)
