"""Listings from many feeds, aggregated, deduplicated, scored and ranked with PySpark."""
