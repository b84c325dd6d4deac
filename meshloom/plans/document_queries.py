"""Queries on nested documents: orders with their lines, as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import schema_check
from meshloom.plans import inputs

SCHEMA = {
    "type": "object",
    "required": ["id", "status", "lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "status": {"enum": ["F", "O"]},
        "total": {"type": "number", "maximum": 150000},
        "priority": {"type": "string", "pattern": "^[1-3]-"},
        "lines": {"type": "array", "minItems": 2, "maxItems": 6, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {
        "line": {
            "type": "object",
            "required": ["quantity"],
            "properties": {"quantity": {"type": "number", "maximum": 45}, "flag": {"enum": ["A", "N"]}, "discount": {"type": "number", "exclusiveMaximum": 0.09}},
        }
    },
}


def documents(spark, d):
    """``(key, text)``: an order as JSON; one of a late priority has a key more, one without lines lacks them."""
    o = inputs.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))
    lines = inputs.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    late = F.when(F.col("o_orderpriority").startswith("5"), F.lit(True))
    doc = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), "lines", late.alias("late"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("key"), F.to_json(doc).alias("text"))


def _issues(spark, d):
    return schema_check.check(documents(spark, d), SCHEMA).select("key", "path", "rule")


def _rules(spark, d):
    found = schema_check.check(documents(spark, d), SCHEMA)
    return found.groupBy("rule", F.regexp_replace("path", r"\[\d+\]", "[]").alias("place")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_documents"))


QUERIES = {"schema_issues": _issues, "schema_rules": _rules}

_ISSUES = """WITH l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_discount) - 1 AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
c AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
issues AS (
  SELECT o_orderkey AS key, '$' AS path, 'required' AS rule FROM c WHERE n = 0
  UNION ALL SELECT o_orderkey, '$', 'additionalProperties' FROM c WHERE o_orderpriority LIKE '5%'
  UNION ALL SELECT o_orderkey, '$.status', 'enum' FROM c WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT o_orderkey, '$.total', 'maximum' FROM c WHERE o_totalprice > 150000
  UNION ALL SELECT o_orderkey, '$.priority', 'pattern' FROM c WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
  UNION ALL SELECT o_orderkey, '$.lines', 'minItems' FROM c WHERE n = 1
  UNION ALL SELECT o_orderkey, '$.lines', 'maxItems' FROM c WHERE n > 6
  UNION ALL SELECT l_orderkey, '$.lines[' || i || '].quantity', 'maximum' FROM l WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey, '$.lines[' || i || '].flag', 'enum' FROM l WHERE l_returnflag NOT IN ('A', 'N')
  UNION ALL SELECT l_orderkey, '$.lines[' || i || '].discount', 'exclusiveMaximum' FROM l WHERE l_discount >= 0.09::DOUBLE)"""

SQL = {
    "schema_issues": _ISSUES + " SELECT * FROM issues",
    "schema_rules": _ISSUES + r" SELECT rule, regexp_replace(path, '\[\d+\]', '[]') AS place, count(*) AS n, count(DISTINCT key) AS n_documents FROM issues GROUP BY ALL",
}
