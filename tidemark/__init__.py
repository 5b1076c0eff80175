"""tidemark: customer-grain marts on Spark.

Raw customer, product, contact and transaction tables are cleaned, rolled up to
one row per customer, refreshed by ingestion watermark, joined into a profile and
checked with rules that return the violating rows.
"""
