"""Meridia: customer-data analytics on PySpark DataFrames."""
