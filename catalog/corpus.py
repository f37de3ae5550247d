"""Business documents rendered from the star schema, next to the text tables as they are.

The statements use only what Spark SQL and DuckDB spell alike, so that both engines render identical
text. ``{orders}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import rows_per_split, spread, tasks_for

TABLES = ("orders", "customer", "supplier", "nation", "part", "documents", "pages", "conversations")

#: The tables that the texts of orders are joined from.
JOINED = ("orders", "customer")

NL = "chr(10)"


def _iso(column: str) -> str:
    return f"CAST(CAST({column} AS DATE) AS STRING)"


def _dmy(column: str) -> str:
    d = _iso(column)
    return f"substr({d}, 9, 2) || '/' || substr({d}, 6, 2) || '/' || substr({d}, 1, 4)"


def _whole(column: str) -> str:
    return f"CAST(CAST(floor({column}) AS BIGINT) AS STRING)"


def _lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


_KEY = "CAST(o_orderkey AS STRING)"
_DATE, _AMOUNT = _dmy("o_orderdate"), _whole("o_totalprice")

INVOICE = _lines(
    "'TAX INVOICE / VAT Invoice'",
    f"'Invoice Number: INV-' || {_KEY}",
    "'Invoice No and Inv No as above'",
    f"'Invoice Date: ' || {_DATE}",
    f"'Due Date: ' || {_DATE} || ' (payment due on receipt of goods)'",
    "'Bill To / Billed To: ' || c_name",
    "'Please remit to our bank, remittance by wire transfer or ACH'",
    "'Quantity, Unit Price and Line Items as shipped'",
    f"'Subtotal: $' || {_AMOUNT}",
    "'Discount 0, Freight 0, GST included'",
    f"'Total Amount: $' || {_AMOUNT}",
    f"'Amount Due: $' || {_AMOUNT} || ', total due, balance due'",
    "'Payment Terms: Net 30'",
    "'Vendor: Supplier House Ltd'",
)
PURCHASE_ORDER = _lines(
    "'PURCHASE ORDER'",
    f"'PO Number: PO-' || {_KEY}",
    "'PO No, P.O. Number and P.O.# as above'",
    f"'Order Number: ' || {_KEY}",
    f"'Order Date: ' || {_DATE}",
    "'Ship To: Dock ' || CAST(c_nationkey AS STRING) || ' Harbour Road'",
    "'Deliver To and Delivery Address as above'",
    "'Buyer: ' || c_name || ', Procurement, Ordered By desk, Approved By Pat Lee'",
    "'Requisition Number: RQ-77, Requisition No as above, order confirmation to follow'",
    f"'Total Value: $' || {_AMOUNT}",
    "'Vendor and Supplier: Parts House, SKU list, Quantity and Unit Price attached'",
    "'Warehouse receiving hours 8 to 5, FOB, Incoterms 2020, Net 60'",
)
RECEIPT = _lines(
    "'RECEIPT - payment received, paid, sale confirmed'",
    f"'Receipt Number: R-' || {_KEY}",
    f"'Transaction ID: T-' || {_KEY} || ', transaction number as above, transaction complete'",
    f"'Date: ' || {_DATE} || ' 10:15'",
    "'Thank you for your purchase. Thank you for your payment.'",
    "'Your order has been placed. Your payment has been processed. Order confirmation and payment confirmation sent'",
    f"'Total Paid: $' || {_AMOUNT} || ', amount paid, cash received, change given, change due 0'",
    "'Store: Corner Market, Merchant 9, Cashier: ' || c_name",
    "'Register 2, Till 4, POS terminal id 8, authorization code A1B2C3, card number ending 1111'",
    "'Visa, Mastercard or Debit Card, loyalty points, return policy 30 days, no refund'",
    "'Subtotal, tax included, coupon, qty, item total, grand total'",
)
WEAK = _lines(
    f"'Invoice Number ' || {_KEY} || ' for ' || c_name",
    f"'Bill To the usual desk, Total Amount: ' || {_AMOUNT}",
)
STATEMENT = _lines(
    "'BANK STATEMENT - statement of account, account statement'",
    "'Account Holder: ' || replace(c_name, '#', ' ')",
    "'Account Number: 00' || CAST(c_custkey AS STRING) || '4455'",
    "'Statement Period: 01/03/2024 to date: 31/03/2024'",
    "'Opening Balance: $0, current balance, ledger balance'",
    "'Closing Balance: $' || " + _whole("abs(c_acctbal)") + " || ', available balance as shown'",
    "'Transactions: transaction date, description, reference number, debit, credit, deposits, withdrawals'",
    "'Branch 12, sort code 10-20-30, routing number 1, IBAN and BIC on file, overdraft limit 0'",
    "'Interest earned 0, direct debit, standing order, ATM withdrawal, wire transfer, online banking'",
    "'Total deposits 0, total withdrawals 0, brought forward, carried forward'",
)
RESUME = _lines(
    "'Jordan ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_nationkey + 1, 1) || 'tone'",
    "'RESUME - Curriculum Vitae (CV)'",
    "'Email: c' || CAST(c_custkey AS STRING) || '@example.com, Phone: (555) 123-4567, Mobile on request'",
    "'LinkedIn linkedin.com/in/c' || CAST(c_custkey AS STRING) || ' and GitHub github.com/c' || CAST(c_custkey AS STRING)",
    "'Career Objective / Objective, Career Summary, Professional Summary'",
    "'Work Experience / Professional Experience / Employment History: 8 years of experience'",
    "'Job Title: Analyst, Company: ' || c_mktsegment || ', Responsibilities, Achievements, promoted, managed, led'",
    "'Education / Academic Background: Bachelor degree, University, Diploma, Qualifications'",
    "'Skills, Technical Skills, Core Competencies, Certifications, Training, Awards'",
    "'References available, references upon request'",
)
CONTRACT = _lines(
    "'SERVICE AGREEMENT'",
    "'This Agreement is a contract between ' || n_name || ' Holdings Ltd and ' || replace(s_name, '#', ' ') || ' Inc'",
    "'Effective Date: 01/0' || CAST(1 + (s_nationkey - 9 * CAST(floor(s_nationkey / 9) AS INT)) AS STRING) || '/2024, term of one year, termination on notice'",
    "'WHEREAS the parties, hereinafter named party of the first part and party of the second part'",
    "'NOW THEREFORE: representations and warranties, indemnification, force majeure, dispute resolution'",
    "'Governed by the laws of ' || n_name || ', governing law, entire agreement'",
    "'Confidentiality, liability, amendment, jurisdiction, arbitration, severability, waiver, fees, milestones'",
    "'IN WITNESS WHEREOF executed with signature and seal'",
)
REPORT = _lines(
    "'Quality Review Report'",
    "'Report Number: QR-' || CAST(p_partkey AS STRING) || ', Report ID as above'",
    "'Report Date: ' || CASE WHEN p_size > 40 THEN '2024-03-15' ELSE "
    "'15/0' || CAST(1 + (p_size - 9 * CAST(floor(p_size / 9) AS INT)) AS STRING) || '/2024' END || ', date of report'",
    "'Prepared By: Quality Team, submitted by the lab'",
    "'Prepared For: ' || replace(p_brand, '#', ' ') || ', submitted to the board'",
    "'Executive Summary, Background, Overview, Scope, Objective, Methodology'",
    "'Analysis of ' || p_name || ' with Findings, Key Findings, Conclusion and Recommendations'",
    "'Metrics, trend, forecast, risk assessment, next steps'",
)

ORDER_COLUMNS = (
    f"'order-' || {_KEY} AS doc_id",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'invoice' WHEN '2-HIGH' THEN 'purchase_order' "
    "WHEN '3-MEDIUM' THEN 'receipt' ELSE 'unclassified' END AS expected_category",
    f"CASE o_orderpriority WHEN '1-URGENT' THEN {INVOICE} WHEN '2-HIGH' THEN {PURCHASE_ORDER} "
    f"WHEN '3-MEDIUM' THEN {RECEIPT} WHEN '4-NOT SPECIFIED' THEN {WEAK} "
    f"ELSE {INVOICE} || {NL} || 'Paid in full' END AS text",
)
ORDER_TEXTS = f"SELECT {', '.join(ORDER_COLUMNS)} FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"

RENDERED = f"""
{ORDER_TEXTS}
UNION ALL
SELECT 'customer-' || CAST(c_custkey AS STRING),
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'resume' ELSE 'bank_statement' END,
       CASE WHEN c_mktsegment = 'BUILDING' THEN {RESUME} ELSE {STATEMENT} END
FROM {{customer}}
UNION ALL
SELECT 'supplier-' || CAST(s_suppkey AS STRING), 'contract', {CONTRACT}
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
UNION ALL
SELECT 'part-' || CAST(p_partkey AS STRING), 'report', {REPORT}
FROM {{part}}
"""

CORPUS = f"""
SELECT doc_id, expected_category, text FROM ({RENDERED}) r
UNION ALL SELECT 'document-' || CAST(doc_id AS STRING), 'unclassified', text FROM {{documents}}
UNION ALL SELECT 'page-' || CAST(page_id AS STRING), 'unclassified', html FROM {{pages}}
UNION ALL SELECT 'turn-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), 'unclassified', text
FROM {{conversations}}
"""

# Files as they might arrive: a name and leading bytes, both chosen by columns of the order.
ORDER_FILES = """
SELECT 'order-' || CAST(o_orderkey AS STRING) AS doc_id,
       'inbox.d/' || CASE o_orderstatus WHEN 'F' THEN 'Scan.' WHEN 'O' THEN '.scan' ELSE 'scan' END
         || CAST(o_orderkey AS STRING)
         || CASE o_orderpriority WHEN '1-URGENT' THEN '.PDF' WHEN '2-HIGH' THEN '.Exe'
              WHEN '3-MEDIUM' THEN '.bin' WHEN '4-NOT SPECIFIED' THEN '' ELSE '.tar.JPEG' END AS file_name,
       CASE o_orderstatus WHEN 'F' THEN '255044462D' WHEN 'O' THEN 'FFD8FFE0'
         ELSE CASE o_orderpriority WHEN '3-MEDIUM' THEN '4D5A90' WHEN '5-LOW' THEN ''
           ELSE '00112233' END END AS head
FROM {orders}
"""


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_spark(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    # Tables that turn into many texts are spread; the looked-up one stays as it is read.
    used = {t: spark_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in statement}
    used = {t: df if t == "nation" else spread(df) for t, df in used.items() if t not in JOINED} | by_customer(
        **{t: df for t, df in used.items() if t in JOINED})
    return spark.sql(statement, **used)


def by_customer(orders: DataFrame, customer: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both sides of the join that renders orders, dealt by its key over one number of tasks.

    A shuffle of the join's own would be cut by the bytes of the orders, which are few next to their texts.
    """
    if customer is None:
        return {"orders": spread(orders)}
    # The number is not asked of the dealt table: adaptive execution would deal all its columns to tell it.
    tasks = tasks_for(sum(rows_per_split(orders)), orders.sparkSession.sparkContext.defaultParallelism)
    return {"orders": orders.repartition(tasks, "o_custkey"), "customer": customer.repartition(tasks, "c_custkey")}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendered and every given text, with the category it was written for."""
    return _in_spark(spark, sf_dir, CORPUS)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_spark(spark, sf_dir, RENDERED)


def order_texts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    dealt = by_customer(orders, customer)
    return dealt["orders"].join(dealt["customer"], F.col("o_custkey") == F.col("c_custkey")).selectExpr(*ORDER_COLUMNS)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_spark(spark, sf_dir, ORDER_FILES).withColumn("content", F.unhex("head"))


def for_duckdb(statement: str) -> str:
    return statement.format(**{t: t for t in TABLES})
