"""Registered queries: name, function of (spark, folder of the tables), and SQL for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Shared parts of the SQL answers.  They start from the tables, not from the derived documents.
LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
         CAST(min(l_quantity) AS INTEGER) AS qty, CAST(round(min(l_discount) * 100) AS INTEGER) AS cents,
         min(l_returnflag) AS flag, min(l_linestatus) AS ls
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

STATUS = "CASE WHEN cents = 0 THEN '-' WHEN ls = 'O' THEN 'it''s open' ELSE 'done' END"

# one row per order line with its place in the table of its order
ROWS = f"""rows AS (
  SELECT l_orderkey AS k, l_linenumber // 50 AS page, l_linenumber AS n, qty, flag, ls, cents, {STATUS} AS status,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 50 ORDER BY l_linenumber) - 1 AS i,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber // 50) AS m
  FROM lines)"""


def file_of(k: str, variation: str) -> str:
    return f"printf('T_Table%d_Variation%03d.htm', {k}, {variation})"


# body cells of the true tables: content with inline tags
CELLS = f"""cells AS (
  SELECT {file_of('k', 'page * 4')} AS file, i, c, norm, content FROM (
    SELECT k, page, i, 0 AS c, CAST(qty AS VARCHAR) AS norm, CAST(qty AS VARCHAR) AS content FROM rows
    UNION ALL SELECT k, page, i, 1, '<b>' || flag || '</b>', flag FROM rows
    UNION ALL SELECT k, page, i, 2, status, status FROM rows
    UNION ALL SELECT k, page, i, 3, 'L&amp;' || n, 'L&' || n FROM rows))"""

HEADERS = f"""heads AS (
  SELECT DISTINCT {file_of('k', 'page * 4')} AS file, k FROM rows),
headers AS (
  SELECT file, 0 AS level, 0 AS h_no, 'Order ' || k AS name, 0 AS lo, 4 AS hi FROM heads
  UNION ALL SELECT file, level, h_no, name, lo, hi FROM heads, (VALUES
    (1, 0, 'Amount', 0, 2), (1, 1, 'State', 2, 4), (2, 0, 'qty', 0, 1), (2, 1, 'flag', 1, 2),
    (2, 2, 'Unknown', 2, 3), (2, 3, 'line', 3, 4)) AS h(level, h_no, name, lo, hi))"""

BOX = "l_partkey % 500 + {s} AS x1, l_suppkey % 500 + {s} AS y1, l_partkey % 500 + {s} + qty + 10 AS x2, l_suppkey % 500 + {s} + l_linenumber * 4 + 8 AS y2"
BOXES = f"""gt AS (
  SELECT l_suppkey AS image, l_orderkey * 8 + l_linenumber AS gt_no, {BOX.format(s='0')},
         CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS iscrowd FROM lines),
det AS (
  SELECT l_suppkey AS image, l_orderkey * 8 + l_linenumber AS det_no, {BOX.format(s='l_linenumber % 4')},
         (cents * 9 + 5) / 100.0::DOUBLE AS score FROM lines WHERE NOT (cents = 0 AND flag = 'A' AND ls = 'O'))"""


def iou_sql(a: str, b: str) -> str:
    inter = (
        f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"
        f" * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))::DOUBLE"
    )
    area = "(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    return f"{inter} / ({area.format(t=a)} + {area.format(t=b)} - {inter})"


PAIRS = f"""pairs AS (
  SELECT * FROM (SELECT det.image, det_no, gt_no, score, iscrowd, {iou_sql('det', 'gt')} AS iou
                 FROM det JOIN gt ON det.image = gt.image
                  AND det.x1 < gt.x2 AND gt.x1 < det.x2 AND det.y1 < gt.y2 AND gt.y1 < det.y2) WHERE iou >= 0.5)"""
