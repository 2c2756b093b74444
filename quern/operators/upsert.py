"""Keyed upserts and the row sets around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.spread import spread_join
from quern.sources.stored import StoredTable

CHUNK_UPDATES = ("text_content", "doc_hash")
CACHE_UPDATES = ("final_response", "session_id", "timestamp")


def upsert(target: DataFrame, batch: DataFrame, key: str, update_cols: Sequence[str]) -> DataFrame:
    """The target after the batch: update on a known key, insert on a new one.

    On a known key `update_cols` come from the batch, even when null, and all
    other columns stay. Both sides hold a key at most once (`latest_per_key`). Each
    side is moved once, and read once. For a table that is kept in files, of which
    only the touched part is to be moved, there is `StoredTable.upsert`.
    """
    cols = target.columns
    update = set(update_cols)
    t = target.select(F.col(key), F.struct(*cols).alias("_old"))
    b = batch.select(F.col(key), F.struct(*cols).alias("_new"))
    old, new = F.col("_old"), F.col("_new")

    def pick(c: str) -> Column:
        first, second = (new, old) if c in update else (old, new)
        return F.when(first.isNotNull(), first[c]).otherwise(second[c]).alias(c)

    return t.join(b, key, "full").select(*[pick(c) for c in cols])


def upsert_chunks(target: DataFrame | StoredTable, batch: DataFrame) -> DataFrame | int:
    """Chunks into a table: a stored one, or rows to rows."""
    return _into(target, batch, "chunk_id", CHUNK_UPDATES)


def upsert_cache(target: DataFrame | StoredTable, batch: DataFrame, keep_errors: bool = False) -> DataFrame | int:
    """Cache upsert. Error responses are left out of the batch unless `keep_errors`."""
    if not keep_errors:
        kind = F.get_json_object("final_response", "$.response_type")
        batch = batch.where(F.coalesce(kind, F.lit("")) != "error")
    return _into(target, batch, "query_hash", CACHE_UPDATES)


def _into(target: DataFrame | StoredTable, batch: DataFrame, key: str, update_cols: Sequence[str]) -> DataFrame | int:
    if isinstance(target, StoredTable):
        return target.upsert(batch, update_cols)
    return upsert(target, batch, key, update_cols)


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], order_cols: Sequence[Column]
) -> DataFrame:
    """The first row per key in the given order.

    The limit on the row number is applied in each task before the shuffle, so
    that at most one row per key and task travels, however frequent the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def changed_rows(
    target: DataFrame, batch: DataFrame, key: str, content_cols: Sequence[str]
) -> DataFrame:
    """Key and `change` (insert, update or unchanged) of each batch row.

    Only keys and content hashes are joined, never the contents.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        # the null mark keeps a null apart from an empty text
        parts = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("null")) for c in content_cols]
        return df.select(key, F.concat_ws("|", *parts).alias(name))

    joined = hashed(batch, "_b").join(hashed(target, "_t"), key, "left")
    return joined.select(
        key,
        F.when(F.col("_t").isNull(), "insert")
        .when(F.col("_t") != F.col("_b"), "update")
        .otherwise("unchanged")
        .alias("change"),
    )


def change_feed(
    before: DataFrame, after: DataFrame, key: str, content_cols: Sequence[str]
) -> DataFrame:
    """What leads from one state to the other: (key, change, before, after), a row per key
    that is inserted, updated or deleted; `before` and `after` are structs of the contents,
    null where there is none. Both sides hold a key at most once.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*content_cols).alias(name))

    both = side(before, "before").join(side(after, "after"), key, "full")
    change = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("after").isNull(), "delete")
        .when(~F.col("before").eqNullSafe(F.col("after")), "update")
    )
    return both.select(key, change.alias("change"), "before", "after").where("change is not null")


def apply_feed(table: StoredTable, feed: DataFrame, update_cols: Sequence[str]) -> int:
    """A change feed into a stored table whose columns the feed's structs hold."""
    rows = feed.select(
        feed.columns[0], *(F.coalesce(F.col("after")[c], F.col("before")[c]).alias(c) if c not in update_cols
                           else F.col("after")[c].alias(c) for c in feed.schema["after"].dataType.fieldNames()),
        (F.col("change") == "delete").alias("_deleted"))
    return table.upsert(rows, update_cols, F.col("_deleted"))


def stale_chunks(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Chunks of documents in the batch whose chunk is in the batch no more."""
    documents = batch.select("doc_hash").distinct()
    again = spread_join(target, documents, ["doc_hash"], "left_semi")
    return again.join(batch.select("chunk_id"), "chunk_id", "left_anti")
