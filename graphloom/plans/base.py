"""The facts as SQL, and the register of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.sources.star import ORDER, Facts

#: The facts and what follows from them, as common table expressions.
CTES = f"""
WITH RECURSIVE f_type AS (
  SELECT p_partkey::BIGINT AS type_id, CASE WHEN p_partkey <> 0 THEN floor((p_partkey - 1) / 3.0)::BIGINT END AS base_type_id FROM part
), f_method AS (
  SELECT o_orderkey::BIGINT AS method_id, (o_custkey % (SELECT count(*) FROM part))::BIGINT AS type_id, (o_orderkey % 4)::INT AS slot,
         o_orderpriority = '1-URGENT' AS is_static, o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AS is_virtual, o_orderkey % 50 = 0 AS is_root
  FROM orders
), f_stmt AS (
  SELECT l_orderkey::BIGINT AS method_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}))::INT AS ordinal,
         l_returnflag AS stmt_kind, l_partkey::BIGINT AS a, l_suppkey::BIGINT AS b, (l_linenumber % 3)::INT AS var
  FROM lineitem
), f_call AS (
  SELECT method_id AS caller, ordinal, ((a * 31 + b * 17 + ordinal) % (SELECT count(*) FROM orders))::BIGINT AS static_target, var AS recv FROM f_stmt WHERE stmt_kind = 'N'
), f_subtype AS (
  SELECT type_id AS sub, type_id AS sup, 0 AS dist FROM f_type
  UNION SELECT s.sub, t.base_type_id, s.dist + 1 FROM f_subtype s JOIN f_type t ON s.sup = t.type_id WHERE t.base_type_id IS NOT NULL
), f_dispatch AS (
  SELECT sub AS recv_type, slot, arg_min(method_id, dist) AS target
  FROM f_subtype JOIN (SELECT type_id, slot, min(method_id) AS method_id FROM f_method WHERE NOT is_static GROUP BY ALL) m ON sup = m.type_id GROUP BY ALL
), f_pts AS (
  SELECT method_id, var, a AS type_id FROM f_stmt WHERE stmt_kind = 'A'
  UNION SELECT p.method_id, s.var, p.type_id FROM f_pts p JOIN f_stmt s ON s.method_id = p.method_id AND s.stmt_kind = 'R' AND (s.var + 1) % 3 = p.var
), f_edge AS (
  SELECT caller, ordinal, static_target AS callee FROM f_call JOIN f_method ON method_id = static_target WHERE NOT is_virtual
  UNION SELECT c.caller, c.ordinal, coalesce(d.target, c.static_target)
  FROM f_call c JOIN f_method m ON m.method_id = c.static_target AND m.is_virtual JOIN f_pts p ON p.method_id = c.caller AND p.var = c.recv
       LEFT JOIN f_dispatch d ON d.recv_type = p.type_id AND d.slot = m.slot
), f_reach AS (
  SELECT method_id FROM f_method WHERE is_root UNION SELECT callee FROM f_reach JOIN f_edge ON caller = method_id
)
"""

QUERIES: dict[str, tuple[Callable[[Facts], DataFrame], str]] = {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add
