"""All queries of this subpackage."""

from aerolith.llm import p1_queries, p2_queries, p5_queries, p6_queries, p7_queries, p8_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (p1_queries, p2_queries, p5_queries, p6_queries, p7_queries, p8_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
