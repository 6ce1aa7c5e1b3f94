"""All registered queries but the training-data ones, and the SQL that gives the same rows."""

from .plans import bench_queries, geometry_queries, graph_queries, sampler_queries

QUERIES = geometry_queries.QUERIES | graph_queries.QUERIES | bench_queries.QUERIES | sampler_queries.QUERIES
ORACLE_SQL = geometry_queries.SQL | graph_queries.SQL | bench_queries.SQL
