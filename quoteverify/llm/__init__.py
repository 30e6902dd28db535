"""Training-data operators: packing, scoring, extraction, dedup and filtering on Spark.

Nothing outside this package imports it; the registry adds its queries when it is present.
"""
