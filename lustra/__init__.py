"""A Spark-native data-cleaning and data-quality engine.

Tables are profiled, their columns classified and a plan compiled: one Spark SQL expression per
output column.  Plans are validated, previewed, locked and materialised as versioned Parquet.
"""
