"""Churn and product-usage analytics on Spark DataFrames."""
