"""Queries on documents laid over others: parts as definitions, and customers' own over those of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import trees
from meshloom.plans import inputs


def _base(spark, d):
    """Parts as definitions, with a mapping in a mapping, a list, and a key that a tenth of them lack."""
    p = inputs.table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.selectExpr(
        "concat('d', p_partkey) AS name",
        """to_json(named_struct('brand', p_brand, 'size', p_size, 'attrs', named_struct('role', p_type, 'place', named_struct('row', p_size % 7, 'name', p_name)), 'tags', array(p_type, p_brand),
          'extra', CASE WHEN p_partkey % 10 > 0 THEN p_partkey END)) AS text""",
    )


def _over(spark, d):
    """Customers' definitions: entries over a mapping, a mapping over a value or a list, a value over a mapping, null over a key, nothing, or a value alone."""
    c = inputs.table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return c.selectExpr(
        "concat('d', c_custkey * 2) AS name",
        """CASE c_custkey % 7 WHEN 0 THEN concat('{"attrs":{"place":{"row":', c_nationkey, ',"new":"', c_mktsegment, '"}}}') WHEN 1 THEN concat('{"size":{"least":', c_nationkey, ',"no":null},"tags":{"a":1}}')
          WHEN 2 THEN concat('{"attrs":"', c_mktsegment, '","brand":"own"}') WHEN 3 THEN '{"brand":null,"attrs":{"place":null,"missing":null}}' WHEN 4 THEN '{}' WHEN 5 THEN '{"attrs":{"place":{"row":null,"name":null}}}'
          ELSE concat('[', c_nationkey, ']') END AS text""",
    )


def _deep(spark, d):
    """All nodes of the merged documents, by path; what a mapping holds are nodes of their own."""
    found = trees.nodes(trees.merged(_base(spark, d), _over(spark, d), deep=True))
    return found.select("name", F.array_join("path", ".").alias("path"), F.coalesce("value", F.lit("{}")).alias("value"))


def _whole(spark, d):
    found = trees.merged(_base(spark, d), _over(spark, d))
    return found.select("name", F.get_json_object("text", "$.brand").alias("brand"), F.get_json_object("text", "$.attrs.place.row").alias("row_"), F.get_json_object("text", "$[0]").alias("first"))


QUERIES = {"library_deep": _deep, "library_whole": _whole}

_DOCUMENTS = """base AS (
  SELECT 'd' || p_partkey AS name, json_merge_patch('{}', json_object('brand', p_brand, 'size', p_size, 'attrs', json_object('role', p_type, 'place', json_object('row', p_size % 7, 'name', p_name)),
    'tags', json_array(p_type, p_brand), 'extra', CASE WHEN p_partkey % 10 > 0 THEN p_partkey END)) AS text FROM part),
over_ AS (
  SELECT 'd' || c_custkey * 2 AS name, CAST(CASE c_custkey % 7 WHEN 0 THEN '{"attrs":{"place":{"row":' || c_nationkey || ',"new":"' || c_mktsegment || '"}}}' WHEN 1 THEN '{"size":{"least":' || c_nationkey || ',"no":null},"tags":{"a":1}}'
    WHEN 2 THEN '{"attrs":"' || c_mktsegment || '","brand":"own"}' WHEN 3 THEN '{"brand":null,"attrs":{"place":null,"missing":null}}' WHEN 4 THEN '{}' WHEN 5 THEN '{"attrs":{"place":{"row":null,"name":null}}}'
    ELSE '[' || c_nationkey || ']' END AS JSON) AS text FROM customer)"""

SQL = {
    "library_deep": f"""WITH {_DOCUMENTS}, both_ AS (
  SELECT coalesce(b.name, o.name) AS name, CASE WHEN o.name IS NULL THEN b.text ELSE json_merge_patch(coalesce(b.text, '{{}}'), o.text) END AS text FROM base b FULL JOIN over_ o ON o.name = b.name)
SELECT name, replace(ltrim(substr(fullkey, 2), '.'), '"', '') AS path, CASE WHEN type = 'OBJECT' THEN '{{}}' ELSE CAST(value AS VARCHAR) END AS value
FROM both_, json_tree(text) t WHERE fullkey NOT LIKE '%[%'""",
    "library_whole": f"""WITH {_DOCUMENTS}, both_ AS (SELECT coalesce(b.name, o.name) AS name, coalesce(o.text, b.text) AS text FROM base b FULL JOIN over_ o ON o.name = b.name)
SELECT name, text ->> '$.brand' AS brand, text ->> '$.attrs.place.row' AS row_, text ->> '$[0]' AS first FROM both_""",
}
