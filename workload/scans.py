"""IO1-IO7 queries."""

from pyspark.sql import functions as F

from creditloom.functions.dates import month_ends
from creditloom.operators.joins import tag_in_list
from creditloom.session import scratch_path
from creditloom.sources.scans import dim_from_list, read_merged, read_pages, read_price, run_sql, scan_dates, scan_window
from workload.base import query, table
from workload.standins import LOAN_ANCHOR, accounts, actions, loan_daily, price


@query("io1_scan_window", """
SELECT client_no, loan_no, pt_date, day_past_due FROM loan_daily WHERE pt_date BETWEEN '1998-02-20' AND '1998-06-30'""",
       ["loan_daily"])
def io1(spark, d):
    return scan_window(loan_daily(spark, d), "pt_date", LOAN_ANCHOR, 130, ["client_no", "loan_no", "pt_date", "day_past_due"])


@query("io2_scan_dates", """
SELECT client_no, tenor, dpd, pt_date FROM accounts
WHERE pt_date IN ('1998-02-28', '1998-03-31', '1998-04-30', '1998-05-31', '1998-06-30')""", ["accounts"])
def io2(spark, d):
    return scan_dates(accounts(spark, d), "pt_date", month_ends(LOAN_ANCHOR), ["client_no", "tenor", "dpd", "pt_date"])


@query("io3_run_sql", """
SELECT client_no, count(*) AS n FROM actions WHERE pt_date > '2024-01-10' AND scene_code = 1001 GROUP BY 1""", ["actions"])
def io3(spark, d):
    return run_sql(
        spark,
        "SELECT client_no, count(*) AS n FROM {log} WHERE pt_date > date_format(date_sub(:anchor, 21), 'yyyy-MM-dd')"
        " AND scene_code = :scene GROUP BY client_no",
        {"anchor": "2024-01-31", "scene": 1001},
        log=actions(spark, d),
    )


@query("io4_read_price", """
SELECT model, brand, strftime(grass_date, '%Y-%m-%d') AS grass_date, price_usd_median FROM price""", ["price"])
def io4(spark, d):
    path = scratch_path(spark, "price")
    price(spark, d).withColumn("grass_date", F.date_format("grass_date", "d/M/yy")).write.csv(path, header=True)
    return read_price(spark, path).withColumn("grass_date", F.date_format("grass_date", "yyyy-MM-dd"))


@query("io5_read_merged", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END AS o_totalprice FROM orders""")
def io5(spark, d):
    path = scratch_path(spark, "merged")
    orders = table(spark, d, "orders")
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    orders.where(~late).select("o_orderkey", "o_custkey").write.parquet(f"{path}/part=old")
    orders.where(late).select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(f"{path}/part=new")
    return read_merged(spark, path).drop("part")


@query("io6_dim_from_list", """
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS wanted
FROM orders""")
def io6(spark, d):
    wanted = dim_from_list(spark, ["2-HIGH", "1-URGENT", "2-HIGH"], "o_orderpriority")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return tag_in_list(orders, "o_orderpriority", wanted, "wanted")


@query("io7_read_pages", """
SELECT DISTINCT lang AS "case", doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents""")
def io7(spark, d):
    """Write the documents as text files by language, then read them back as whole pages.

    A file holds at most 100 documents with marks around each, so no row grows with the table.
    """
    path = scratch_path(spark, "pages")
    mark = F.format_string("\x02%d\x03", "doc_id")
    lines = table(spark, d, "documents").select(F.concat(mark, F.col("text"), F.lit("\x04")).alias("value"), "lang")
    lines.write.option("maxRecordsPerFile", 100).partitionBy("lang").text(path)
    cut = read_pages(spark, path).select(
        F.regexp_replace("case", "^lang=", "").alias("case"),
        F.explode(F.regexp_extract_all("text", F.lit("(?s)\x02([^\x04]*)\x04"), F.lit(1))).alias("page"),
    )
    return cut.select(
        "case",
        F.substring_index("page", "\x03", 1).cast("bigint").alias("doc_id"),
        F.length(F.regexp_extract("page", "(?s)\x03(.*)$", 1)).alias("chars"),
    )


