"""recsmith: recommendation analytics on Spark DataFrames.

Ingest and validate user-item interactions, build text / image / structured
features, pool them per item, fit bias, factorization and MLP scorers with the
data kept distributed, rank items for whole tables (or streams) of queries and
evaluate the rankings.
"""

__all__ = ["session"]
