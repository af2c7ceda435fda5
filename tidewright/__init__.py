"""Tidewright: seasonal time-series models on Spark DataFrames.

sources/    series from tables: ordering, long regressors, Parquet readers
functions/  column builders: arrays as matrices, polynomials, distributions
operators/  relational operators: differencing, lags, matrices, filter, forecast
plans/      queries that tie operators together, with their SQL twins
streaming/  chunked and stateful variants for series beyond one task's memory
llm/        text-corpus operators; nothing outside that folder imports it
"""
