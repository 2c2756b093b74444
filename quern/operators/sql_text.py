"""Running SQL texts with a bounded preview and a corrected second attempt."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.fixed import PREVIEW_ROWS, SQL_ATTEMPTS, SQL_FAILED, UNKNOWN_COLUMN

NOT_A_QUERY = "Only queries can be run."

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SqlOutcome:
    sql: str
    rows: DataFrame | None
    error: str | None


def run_sql(
    spark: SparkSession,
    text: str,
    correct: Callable[[str, str], str] | None = None,
    attempts: int = SQL_ATTEMPTS,
    limit: int = PREVIEW_ROWS,
) -> SqlOutcome:
    """Runs a statement and keeps at most `limit` rows.

    A statement may fail only when it executes, so the preview is taken inside
    the attempt. Between attempts `correct(text, error)` may supply another text.
    """
    error = ""
    for attempt in range(attempts):
        try:
            result = spark.sql(text)
            rows = result.limit(limit).collect()
            return SqlOutcome(text, spark.createDataFrame(rows, result.schema), None)
        except Exception as failure:  # any failure of a user's text is an outcome
            error = str(failure)
            log.warning("attempt %d failed: %s", attempt + 1, error)
            if correct is None:
                break
            if attempt + 1 < attempts:
                text = correct(text, error).strip()
    return SqlOutcome(text, None, SQL_FAILED.format(error=error))


def check_text(spark: SparkSession, text: str) -> str | None:
    """What is wrong with a query text, or None. Nothing runs: Spark resolves the names,
    so aliases, common table expressions and qualified names count as what they are. A
    text that changes something is refused without being looked at further, as some
    commands take effect when they are resolved."""
    if not re.match(r"(?is)(\s|--[^\n]*\n|/\*.*?\*/|\()*(select|with|values|from|table)\b", text or ""):
        return NOT_A_QUERY
    try:
        spark.sql(text)
        return None
    except AnalysisException as error:
        if (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            name = error.getMessageParameters().get("objectName", "")
            return UNKNOWN_COLUMN.format(name=name.replace("`", ""))
        return error.getCondition() or str(error)


def run_texts(
    texts: DataFrame, id_col: str = "query_id", text_col: str = "query_text", limit: int = PREVIEW_ROWS
) -> DataFrame:
    """(id, error, sql_result) of each query text: the text is checked first and runs only
    if it passes; each distinct text is checked and run once, however often it is asked.

    The result is at most `limit` rows, a JSON object a line. Distinct texts pass through
    the driver one by one, as each is a job of its own; their results do not: they are one
    union, and come back to the ids by a join.
    """
    spark = texts.sparkSession
    key = F.md5(text_col).alias("_key")
    known = [(r["_key"], r[text_col]) for r in texts.where(F.col(text_col).isNotNull()).select(key, text_col).distinct().toLocalIterator()]
    checked = [(name, text, check_text(spark, text)) for name, text in known]
    results = spark.createDataFrame([], "_key string, sql_result string")
    for name, text, error in checked:
        if error is None:
            df = spark.sql(text).limit(limit)
            names = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may repeat
            line = F.to_json(F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns))), {"ignoreNullFields": "false"})
            rows = names.select(line.alias("line")).agg(F.array_join(F.collect_list("line"), "\n").alias("sql_result"))
            results = results.unionByName(rows.select(F.lit(name).alias("_key"), "sql_result"))
    errors = spark.createDataFrame([(name, error) for name, _, error in checked], "_key string, error string")
    asked = texts.select(id_col, key)
    return asked.join(errors, "_key", "left").join(results, "_key", "left").select(
        id_col, F.when(F.col("_key").isNull(), F.lit(NOT_A_QUERY)).otherwise(F.col("error")).alias("error"), "sql_result")


def preview(df: DataFrame, order_cols: list, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first `n` rows in a stated order, so that a second look shows the same."""
    return df.orderBy(*order_cols).limit(n)


def result_text(rows: DataFrame, by: list[str], order_cols: list[str]) -> DataFrame:
    """Previewed rows, one JSON object per line, as one text per `by`.

    For previews only: the caller bounds the rows per group.
    """
    cols = [c for c in rows.columns if c not in by]
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    packed = F.array_sort(F.collect_list(F.struct(*order_cols, line.alias("_line"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(packed, lambda r: r["_line"]), "\n").alias("sql_result")
    )
