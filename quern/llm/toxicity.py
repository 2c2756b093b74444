"""Toxicity by a chain of linear models.

The categories are predicted one after the other; the model of a category sees the
words of the text and what the models before it said. It is trained on out-of-fold
predictions of those, as the predictions it will meet are not those of models that
have seen the text's own label.

The registered query chains the two judgements that the `labels` table has: whether a
text is of low quality, then whether it is toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import body, prepared, table
from quern.llm.linear import Model, Rows, fit, folds, sigmoid, telling

BUCKETS = 1 << 18
#: Labelled documents the models are fitted on at most: of those given, the ones with the
#: smallest hashes of their ids. All other steps cover all documents.
SAMPLE_ROWS = 6_000
FOLDS = 4
THRESHOLD = 0.5
_KEPT_WORDS = 200_000
_find = re.compile(r"\w+").findall


class _Buckets(dict):
    """Words to their buckets, or to the places of chosen buckets; -1 for others."""

    def __init__(self, places: dict[int, int] | None = None):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        bucket = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        self[word] = at = bucket if self.places is None else self.places.get(bucket, -1)
        return at


def entries(text: bytes, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, and 1 + log of how often each occurs."""
    words = _find(text.decode("utf-8", "replace").lower())
    at = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    col, n = np.unique(at[at >= 0], return_counts=True)
    return col, 1 + np.log(n)


@dataclass
class Chain:
    """`columns`: the buckets in use. A model's weights are for these, then for the
    logits of the categories before it."""

    names: list[str]
    columns: np.ndarray
    models: list[Model]

    def probabilities(self, rows: Rows) -> np.ndarray:
        logits = np.zeros((len(rows), 0))
        for model in self.models:
            logits = np.column_stack([logits, model.logit(rows.plus(logits))])
        return sigmoid(logits)

    def score(self, text: Column) -> Column:
        """struct of one probability per category, named as the categories."""
        chain = self
        made: list[_Buckets] = []

        @F.pandas_udf(", ".join(f"`{n}` double" for n in self.names))
        def of(texts: pd.Series) -> pd.DataFrame:
            if not made:
                made.append(_Buckets({int(c): i for i, c in enumerate(chain.columns)}))
            rows = Rows.of([entries(t, made[0]) for t in texts], len(chain.columns))
            return pd.DataFrame(chain.probabilities(rows), columns=chain.names)

        return of(body(text))


def _narrowed(rows: Rows, columns: np.ndarray) -> Rows:
    place = np.full(rows.width, -1)
    place[columns] = np.arange(len(columns))
    at = place[rows.col]
    start = np.concatenate([[0], np.cumsum(at >= 0)])[rows.start]
    return Rows(start, at[at >= 0], rows.value[at >= 0], len(columns))


def _fitted(rows: Rows, y: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, Model]:
    """The buckets that tell the category, and the model on them and on `said`."""
    columns = np.flatnonzero(telling(rows, y))
    return columns, fit(_narrowed(rows, columns).plus(said), y, l2=2e-5, steps=400, rate=1.0)


def fit_chain(rows: Rows, y: np.ndarray, names: Sequence[str]) -> Chain:
    """`y`: rows × categories, in the order in which the chain asks for them."""
    fold = folds(len(rows), FOLDS)
    said = np.zeros((len(rows), 0))
    fitted: list[tuple[np.ndarray, Model]] = []
    for j in range(len(names)):
        fitted.append(_fitted(rows, y[:, j], said))
        held = np.zeros(len(rows))
        for k in range(FOLDS):
            out = fold == k
            if out.any():
                columns, model = _fitted(rows.take(~out), y[~out, j], said[~out])
                held[out] = model.logit(_narrowed(rows.take(out), columns).plus(said[out]))
        said = np.column_stack([said, held])
    used = np.unique(np.concatenate([c for c, _ in fitted])) if fitted else np.zeros(0, np.int64)
    models = []
    for j, (columns, model) in enumerate(fitted):
        weights = np.zeros(len(used) + j)
        weights[np.searchsorted(used, columns)] = model.weights[:len(columns)]
        weights[len(used):] = model.weights[len(columns):]
        models.append(Model(weights, model.bias))
    return Chain(list(names), used, models)


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` with the smallest row of each `_id`; `keys` are the same in all rows of one."""
    others = [c for c in rows.columns if c not in ("_id", *keys)]
    least = rows.groupBy("_id", *keys).agg(F.min(F.struct(*others)).alias("_least"))
    return least.select("_id", "_least.*", *keys)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, columns: dict[str, Column], judgements: Sequence[str], limit: int
) -> DataFrame:
    """At most `limit` labelled documents: `columns` of them and their judgements.

    Rows with a null id or judgement are left out; of labels that repeat an id, the
    smallest count. Labels of documents that are not given take no place, and a document
    id takes one, however many rows have it.
    """
    order = F.xxhash64("_id")
    judged = labels.select(F.col(id_col).alias("_id"), *(F.col(j).cast("double").alias(f"_{j}") for j in judgements))
    judged = judged.dropna().groupBy("_id").agg(*(F.min(f"_{j}").alias(f"_{j}") for j in judgements))
    given_ids = docs.select(F.col(id_col).alias("_id")).distinct()
    chosen = judged.join(given_ids, "_id", "left_semi").orderBy(order, "_id").limit(limit)
    given = docs.select(F.col(id_col).alias("_id"), *(c.alias(f"_{n}") for n, c in columns.items()))
    found = given.join(F.broadcast(chosen), "_id")  # `limit` rows of numbers at most
    return one_each(found, *(f"_{j}" for j in judgements)).orderBy(order, "_id").limit(limit)


def train(
    docs: DataFrame, labels: DataFrame, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Chain:
    """A chain over the 0/1 columns `names` of `labels`, in that order."""
    prepared(docs.sparkSession)
    sample = labelled_sample(docs, labels, id_col, {"text": body(F.col(text_col))}, names, sample_rows)

    @F.pandas_udf("col array<int>, value array<float>")
    def of(texts: pd.Series) -> pd.DataFrame:
        buckets = _Buckets()
        found = [entries(t, buckets) for t in texts]
        return pd.DataFrame({"col": [c.astype("i4") for c, _ in found], "value": [v.astype("f4") for _, v in found]})

    e = of("_text")
    got = sample.select(e.alias("e"), *(f"_{n}" for n in names)).select("e.col", "e.value", *(f"_{n}" for n in names)).toArrow()
    sizes = pc.list_value_length(got["col"]).to_numpy()
    rows = Rows(
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(got["col"]).to_numpy().astype(np.int64),
        pc.list_flatten(got["value"]).to_numpy().astype(np.float64), BUCKETS)
    y = np.column_stack([got[f"_{n}"].to_numpy() for n in names]).astype(float)
    return fit_chain(rows, y, names)


def _judgements(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` whose toxicity is `threshold` or less; all columns as they are.

    Null and wordless texts get the chain's prior. Without labels, or with labels of other
    documents only, all stay. Rows that repeat are each judged; no documents give no rows.
    """
    chain = train(docs, _judgements(labels), ["low_quality", "toxic"])
    return docs.where(chain.score(F.col("text"))["toxic"] <= threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both probabilities of every document, and whether it is taken as toxic.

    Null and wordless texts get the chain's prior; without labels every probability
    is a half and no document is toxic. Rows that repeat are scored each time.
    """
    prepared(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = train(docs, _judgements(labels), ["low_quality", "toxic"])
    return docs.select("doc_id", chain.score(F.col("text")).alias("p")).select(
        "doc_id", F.col("p.low_quality").alias("p_low_quality"), F.col("p.toxic").alias("p_toxic"),
        (F.col("p.toxic") > THRESHOLD).alias("toxic"))
