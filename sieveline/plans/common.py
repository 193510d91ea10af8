"""Tables as the queries use them, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.errors import SievelineError
from sieveline.operators.schema import FieldDef, Schema
from sieveline.storage import rank_rows

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query by the name of its function, with the SQL it must agree with."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SCHEMA = Schema(
    (
        FieldDef("title", "text", boost=2.0), FieldDef("text", "text"), FieldDef("lang", "keyword"), FieldDef("source", "keyword"),
        FieldDef("views", "u64"), FieldDef("n_chars", "i64"), FieldDef("quality", "f64"), FieldDef("published", "bool"), FieldDef("ts", "date_millis"),
        FieldDef("external_id", "keyword", indexed=False),
    )
)


def millis(column: str):
    """Milliseconds of a time without zone, whatever zone the session has."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """documents with the fields of SCHEMA."""
    return table(spark, folder, "documents").select(
        "doc_id", "title", "text", "lang", "source", F.col("views").cast("decimal(20,0)").alias("views"), F.col("n_chars").cast("long").alias("n_chars"), "quality", "published", millis("ts").alias("ts"), "external_id"
    )


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text): each query once."""
    return table(spark, folder, "queries").where("text is not null").groupBy("query_id").agg(F.min("text").alias("text"))


def fused_lists(spark: SparkSession, folder: str, which: str) -> DataFrame:
    """(query_id, doc_id, rank, score) of the lists of the fusion cases; query_id is the case."""
    cases = table(spark, folder, "fusion").where("id is not null").groupBy("id").agg(F.min(which).alias("l"), F.min(f"{which}_scores").alias("s"))
    rows = cases.select(F.col("id").alias("query_id"), F.posexplode("l").alias("at", "doc_id"), "s")
    rows = rows.select("query_id", "doc_id", (F.col("at") + 1).alias("rank"), F.get("s", F.col("at")).alias("score")).where("doc_id is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score")).select("query_id", "doc_id", "rank", "score")


def scored_of(spark: SparkSession, folder: str, stage: str | None = None) -> DataFrame:
    """(query_id, doc_id, score): each passage of results with its best finite score."""
    rows = table(spark, folder, "results").where("query_id is not null and id is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    if stage:
        rows = rows.where(F.col("stage") == stage)
    return rows.groupBy("query_id", F.col("id").alias("doc_id")).agg((F.max("score") + 0.0).alias("score"))


def run_of(spark: SparkSession, folder: str, stage: str | None = None, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): results as a run; most: its first places, which Spark cuts before the exchange."""
    best, order = scored_of(spark, folder, stage), [F.desc("score"), F.asc("doc_id")]
    if most is None:
        return rank_rows(best, ["query_id"], order)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)


def judgements(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, doc_id, grade): recorded answers as judgements, 2 for the first three places, 1 for the others."""
    items = table(spark, folder, "fusion").where("query_id is not null and expected is not null").select("query_id", F.explode("expected").alias("x")).select("query_id", F.col("x.id").alias("doc_id"), F.col("x.score").alias("score")).where("doc_id is not null and score is not null and not isnan(score)")
    best = items.groupBy("query_id", "doc_id").agg((F.max("score") + 0.0).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("place", place).select("query_id", "doc_id", F.when(F.col("place") <= 3, 2).otherwise(1).alias("grade"))


# the same in SQL

#: Letters and digits: SQL has no class for alphabetic marks, so those the tables hold are named.
ALNUM = r"\p{L}\p{N}\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}"
POSITIONS = rf"len(regexp_extract_all(text, '[{ALNUM}]+|[^{ALNUM} \t\n\r\f\x{{0B}}]')) + 2"

ASKED = "asked AS (SELECT query_id, min(text) AS text FROM queries WHERE text IS NOT NULL GROUP BY query_id)"


def tokens(column: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({column}, '[{ALNUM}]+'), lambda t: strlen(t) < 40), lambda t: lower(t))"


def norm(length: str) -> str:
    shift = f"greatest(CAST(floor(log2(greatest({length} - 24, 1))) AS INTEGER) - 3, 0)"
    return f"(CASE WHEN {length} < 40 THEN {length} ELSE ((({length} - 24) >> {shift}) << {shift}) + 24 END)"


def postings(name: str, column: str, boost: float = 1.0, keyword: bool = False, quantise: bool = True) -> str:
    """CTEs <name>_terms (doc_id, term, tf, len) and <name>_w (doc_id, term, w: the score of one occurrence in a query)."""
    said = f"[{column}]" if keyword else tokens(column)
    length = norm("p.len") if quantise else "p.len"
    return f"""
{name}_said AS (SELECT doc_id, {said} AS toks FROM documents WHERE {column} IS NOT NULL),
{name}_terms AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM {name}_said) GROUP BY doc_id, term),
{name}_const AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len(toks)) FROM {name}_said) / (SELECT count(*) FROM documents) AS avg_len),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_terms GROUP BY term),
{name}_w AS (
  SELECT p.doc_id, p.term, {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * {length} / avg_len)) AS w
  FROM {name}_terms p JOIN {name}_df USING (term), {name}_const
)"""


def asked_terms(column: str = "text") -> str:
    return f"asked_terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens(column)}) AS term FROM asked) GROUP BY query_id, term)"


def best(scores: str, k: int, by: str = "query_id") -> str:
    """SELECT of the k best of (query_id, doc_id, score)."""
    return f"SELECT {by}, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM {scores} QUALIFY rank <= {k}"


def codes(name: str, source: str) -> str:
    """CTEs of which <name> has the eight-bit codes, scale and norm of the vectors v of `source`."""
    return f"""
{name}_v AS ({source}),
{name}_s AS (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN CAST(1 AS FLOAT) ELSE CAST(CAST(list_max(list_transform(v, lambda x: abs(x))) AS DOUBLE) / 127 AS FLOAT) END AS scale FROM {name}_v),
{name}_c AS (SELECT *, list_transform(v, lambda x: CAST(greatest(-127, least(127, round(CAST(CAST(CAST(x AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT) AS DOUBLE)))) AS TINYINT)) AS codes FROM {name}_s),
{name} AS (SELECT *, CAST(sqrt(CAST(list_sum(list_transform(codes, lambda c: CAST(c AS BIGINT) * c)) AS DOUBLE)) * CAST(scale AS DOUBLE) AS FLOAT) AS norm FROM {name}_c)"""


def letters(text: str, dim: int = 16) -> str:
    """The vector that LetterEmbedder gives a text."""
    return f"list_transform({list('abcdefghijklmnopqrstuvwxyz'[:dim])}, lambda c: CAST(len({text}) - len(replace({text}, c, '')) + 1 AS FLOAT))"


def outcomes(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(case_id, error): the name of the error that each case ends in, none where it ends well."""
    rows = []
    for name, work in cases.items():
        try:
            work()
            rows.append((name, "none"))
        except SievelineError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "case_id string, error string")


RUN = """{name} AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, id AS doc_id, max(score) + 0.0 AS score FROM results WHERE query_id IS NOT NULL AND id IS NOT NULL AND isfinite(score) {where} GROUP BY ALL
  )
)"""


def run_sql(name: str = "run", stage: str | None = None) -> str:
    return RUN.format(name=name, where=f"AND stage = '{stage}'" if stage else "")


JUDGEMENTS = """judged AS (
  SELECT query_id, doc_id, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3 THEN 2 ELSE 1 END AS grade FROM (
    SELECT query_id, x.id AS doc_id, max(x.score) + 0.0 AS score FROM (SELECT query_id, unnest(expected) AS x FROM fusion WHERE query_id IS NOT NULL AND expected IS NOT NULL)
    WHERE x.id IS NOT NULL AND x.score IS NOT NULL AND NOT isnan(x.score) GROUP BY ALL
  )
)"""


def list_sql(name: str, which: str) -> str:
    return f"""{name} AS (
  SELECT query_id, doc_id, min(rank) AS rank, arg_min(score, rank) AS score FROM (
    SELECT id AS query_id, unnest(l) AS doc_id, unnest(range(1, len(l) + 1)) AS rank, unnest(list_resize(coalesce(s, []), len(l))) AS score FROM (
      SELECT id, min({which}) AS l, min({which}_scores) AS s FROM fusion WHERE id IS NOT NULL GROUP BY id
    )
  ) WHERE doc_id IS NOT NULL GROUP BY ALL
)"""
