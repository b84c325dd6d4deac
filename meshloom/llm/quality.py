"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once. The ledger keeps the measurements and one bit for each
failed rule; a policy is a versioned set of rules, applied as a mask. Ablations count
documents from the ledger's distinct masks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Name of each rule, in the order of its bit, with the condition on the measurements that fails it.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "shouting": "2 * n_upper > n_letters",
}
#: The rules that the base verdict stands on.
BASE = ("few_words", "repeated_words")
#: Policies by version. Later versions add rules; none is changed.
POLICIES = {
    "v1": BASE,
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    """Bitmask of rule names."""
    return sum(1 << list(RULES).index(r) for r in rules)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions use them."""
    made = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select("*", F.inline(made))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every whole text; a null text counts as empty.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines``, ``n_repeat_words``, ``n_letters`` (A-Z and a-z), ``n_upper``.
    Windows of three words are compared by a 64-bit hash; their positions are sorted
    by hash within the row, so equal windows are neighbours.
    """
    blank = F.lit(" \t\n\x0b\x0c\r")
    no_words = F.array().cast("array<string>")
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trimmed = F.trim("t", blank)
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, blank) != "")
    df = _once(
        df,
        w=F.when(trimmed == "", no_words).otherwise(F.split(trimmed, f"[{SPACE}]+")),
        lines=lines,
        symbols=F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", "")),
        upper=F.length("t") - F.length(F.regexp_replace("t", r"[A-Z]", "")),
        lower=F.length("t") - F.length(F.regexp_replace("t", r"[a-z]", "")),
    ).drop("t")
    n = F.size("w")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p")),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = _once(
        df.select("id", "w", *[F.col(c) for c in ("lines", "symbols", "upper", "lower")]),
        s=F.when(n < 3, none).otherwise(F.sort_array(windows)),
        n=n,
        chars=F.length(F.array_join("w", "")),
        n_lines=F.size("lines"),
        n_dup=F.size("lines") - F.size(F.array_distinct("lines")),
    ).drop("w", "lines")
    twice = F.filter(
        F.sequence(F.lit(0), F.size("s") - 1),
        lambda i: F.coalesce(F.get("s", i)["h"] == F.get("s", i - 1)["h"], F.lit(False))
        | F.coalesce(F.get("s", i)["h"] == F.get("s", i + 1)["h"], F.lit(False)),
    )
    at = F.sort_array(F.transform(twice, lambda i: F.get("s", i)["p"]))
    df = _once(df, at=F.when(F.size("s") == 0, F.array().cast("array<int>")).otherwise(at)).drop("s")
    # a window at p covers p to p + 2; windows that overlap cover each word once
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"), F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dup").cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        (F.col("upper") + F.col("lower")).cast("long").alias("n_letters"), F.col("upper").cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document and ``fail_bits``, one bit for each failed rule.

    One row for each row of ``docs``, repeated rows included; null and empty texts fail
    ``few_words`` only. Other columns of ``docs`` are not read.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return measure(docs, id_col, text_col).withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (no rule of the policy failed, nor the base)."""
    base, own = mask(BASE), mask(POLICIES[version]) | mask(BASE)
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(own)) == 0
    )


def ablations(rows: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail no other rule of it.

    The latter come back if the rule is left out. Counted over the distinct masks, of which
    there are at most two to the number of rules.
    """
    own = mask(POLICIES[version])
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in POLICIES[version]]))
    long = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return long.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(failed & (F.bit_count("bits") == 1), F.col("n"))), F.lit(0)).alias("n_only"),
    )


#: DuckDB SQL of the ledger under policy v2.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
words AS (SELECT n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs),
windows AS (
  SELECT n, p, count(*) OVER (PARTITION BY n, x, y, z) AS c
  FROM (SELECT n, p, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY n ORDER BY p)) WHERE z IS NOT NULL),
covered AS (
  SELECT n, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT n, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE c > 1) GROUP BY n),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM docs LEFT JOIN covered USING (n)),
ledger AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 16 * n_words)::INT
    + 32 * (2 * n_upper > n_letters)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM ledger
"""
