"""Secret scans with DataFrame functions only.

Fixed patterns give the base spans. Two character Markov models, of random strings and
of ordinary identifiers, judge the long tokens that no pattern covers: a token whose
log-likelihood ratio is high enough becomes a ``markov`` span. The models are counts of
character pairs in labelled samples; the alphabet bounds their size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest

#: Fixed patterns, in the order of their kinds; group 0 is the span.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Least length of an assigned value, and of a token that the models judge.
ASSIGN_LENGTH = 12
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters the models tell apart, all others being one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIZE = len(ALPHABET) + 1
#: Weight, in pairs, of a character's overall share in its share after each other character.
PRIOR = 8.0
#: Different characters that a token needs at least to be judged, which leaves out rulers and padding.
DISTINCT = 8
#: Nats for each character that make a token random.
THRESHOLD = 4.0
#: Documents whose ordinary words, and those whose assigned values, are labelled samples; of different texts, those of lowest hash.
SAMPLE_DOCS = 2000
#: Random strings made by rule, a labelled sample that no corpus can lack.
SAMPLE_STRINGS = 4000

_SPANS = "array<struct<start:int,k:int,end:int>>"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _spans(text: str, pattern: str, kind: int, values: Column | None = None) -> Column:
    """Spans of a pattern's matches, found from the lengths of matches and of what lies between.

    With ``values``, one for each match, those shorter than ASSIGN_LENGTH are dropped.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern), F.length)
    parts = F.arrays_zip(
        between.alias("gap"), F.transform(found, F.length).alias("n"), F.transform(values if values is not None else found, F.length).alias("v")
    )
    empty = F.array().cast(_SPANS)
    least = ASSIGN_LENGTH if values is not None else 0

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("k"), end.alias("end")))
        kept = x["n"].isNotNull() & (x["v"] >= least)
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(F.col(text).rlike(pattern), spans).otherwise(empty)


def base_spans(docs: DataFrame, text_col: str = "t") -> DataFrame:
    """``docs`` with ``base``: spans of the fixed patterns, sorted by start, then kind."""
    values = F.regexp_extract_all(text_col, F.lit(ASSIGN), F.lit(2))
    df = _once(
        docs,
        assign=_spans(text_col, ASSIGN, 0, values),
        access=_spans(text_col, ACCESS, 1),
        hexes=_spans(text_col, HEX, 2),
    )
    return df.withColumn("base", F.sort_array(F.concat("assign", "access", "hexes"))).drop("assign", "access", "hexes")


def random_strings(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """``(value, random)``: strings of 32 characters, each drawn by a hash from one of four alphabets."""
    letters = ("0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET)
    sets = F.element_at(F.array(*map(F.lit, letters)), (F.pmod("id", F.lit(len(letters))) + 1).cast("int"))
    drawn = F.transform(
        F.sequence(F.lit(1), F.lit(32)),
        lambda i: F.substring("set", F.pmod(F.xxhash64("id", i), F.length("set")).cast("int") + 1, F.lit(1)),
    )
    made = spark.range(n).withColumn("set", sets)
    return made.select(F.array_join(drawn, "").alias("value"), F.lit(True).alias("random"))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled ``(value, random)`` from at most twice SAMPLE_DOCS documents, and strings made by rule.

    Random are the assigned values; ordinary are the words of four or more letters of
    texts from which the matches of the fixed patterns are cut out.
    """
    texts = docs.select(F.col(text_col).alias("t")).where("t IS NOT NULL")
    some = lowest(texts, ["t"], SAMPLE_DOCS)
    with_values = lowest(texts.where(F.col("t").rlike(ASSIGN)), ["t"], SAMPLE_DOCS)
    values = with_values.select(F.explode(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("value"))
    values = values.where(F.length("value") >= ASSIGN_LENGTH).select("value", F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z_][A-Za-z0-9_/+=-]{3,}"), F.lit(0))).alias("value"))
    return values.union(words.select("value", F.lit(False).alias("random"))).union(random_strings(docs.sparkSession))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every pair of characters, random over ordinary.

    Each model's shares after a character are smoothed with the character's overall share.

    ``labelled`` has ``value`` and ``random``; rows with a null are ignored. Counted by
    Spark; what comes to the driver is at most two counts for each pair of characters.
    """
    code = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    df = _once(labelled.where("value IS NOT NULL AND random IS NOT NULL"), c=code)
    pair = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * SIZE + F.get("c", i + 1))
    pairs = df.where("size(c) >= 2").select("random", F.explode(pair).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    log = {}
    for label in (True, False):
        table = [[counts.get((label, a * SIZE + b), 0) for b in range(SIZE)] for a in range(SIZE)]
        every = sum(map(sum, table))
        single = [(sum(row[b] for row in table) + 0.5) / (every + 0.5 * SIZE) for b in range(SIZE)]
        for a, row in enumerate(table):
            total = sum(row) + PRIOR
            log[label, a] = [math.log((n + PRIOR * single[b]) / total) for b, n in enumerate(row)]
    return [x - y for a in range(SIZE) for x, y in zip(log[True, a], log[False, a])]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string for each of its character pairs."""
    table = F.lit(model)

    def step(acc: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c)
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * SIZE + code))
        return F.struct(code.alias("last"), (acc["sum"] + gain).alias("sum"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.split(value, ""), start, step, lambda a: a["sum"])
    return total / F.greatest(F.length(value) - 1, F.lit(1))


def scan(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``spans``: arrays of (start, kind number, end).

    Offsets are code points, ends exclusive; ``spans`` has the base ones and those the
    models add, which overlap no base span. Null and empty texts have none. Repeated rows
    are scanned each; other columns pass through, whatever their names, but for ``base`` and
    ``spans``, which are replaced.
    """
    # columns go by number meanwhile, so that none can clash with a name in here
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    df = docs.toDF(*own.values()).withColumn("text", F.coalesce(own[text_col], F.lit("")))
    df = base_spans(df, "text")
    tokens = F.when(F.col("text").rlike(TOKEN), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    df = _once(df, token=F.coalesce(tokens, F.array().cast("array<string>")), at=_spans("text", TOKEN, 3))
    random = F.transform(F.arrays_zip(F.col("token").alias("v"), F.col("at").alias("s")), lambda x: F.when(
        ~F.exists("base", lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"]))
        & (F.size(F.array_distinct(F.split(x["v"], ""))) >= DISTINCT) & (ratio(x["v"], model) >= THRESHOLD), x["s"]
    ))
    added = F.filter(random, lambda s: s.isNotNull())
    return df.select(*[F.col(k).alias(c) for c, k in own.items() if c not in ("base", "spans")], "base", F.sort_array(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash and list of the spans that :func:`scan` found."""

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == kind)).cast("long")

    return found.select(
        id_col, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans give one mark.

    Null texts stay null, other columns as they are; repeated rows stay.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = scan(docs.toDF(*own.values()), model, own[text_col])
    last = F.length(own[text_col])
    merged = F.aggregate(
        F.concat("spans", F.array(F.struct(last.alias("start"), F.lit(-1).alias("k"), last.alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"], F.substring(own[text_col], a["at"] + 1, s["start"] - a["at"]), F.when(s["k"] >= 0, mark).otherwise("")
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: a["out"],
    )
    clean = F.when(F.size("spans") > 0, merged).otherwise(F.col(own[text_col]))
    return found.select(*[(clean if c == text_col else F.col(k)).alias(c) for c, k in own.items()])
