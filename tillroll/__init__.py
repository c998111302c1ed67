"""Retail invoice-line analytics on Spark: landing, star schema, RFM, data quality."""
