"""Registered queries of the receipt operators and their DuckDB SQL."""

from slipmill.plans import image_queries, pixel_queries, text_queries, vision_queries

_MODULES = (text_queries, vision_queries, pixel_queries, image_queries)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
