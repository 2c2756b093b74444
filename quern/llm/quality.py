"""Document quality by co-training.

Two classifiers see different sides of a document: the text view its letters, words
and lines, the page view its language, source and stated length. Round by round each
is fitted on the labelled documents and on pseudo-labels that the other view was
confident of for unlabelled ones. How sure a view may be is read from labelled
documents kept aside (Platt scaling), so a view that knows little hands over nothing.
A last model, on further documents kept aside, weighs the two calibrated views for the
score.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import body, prepared, table
from quern.llm.linear import Model, Rows, fit, sigmoid
from quern.llm.toxicity import labelled_sample, one_each

#: Labelled documents, and unlabelled ones for pseudo-labels, at most: those with the
#: smallest hashes of their ids. Scoring covers all documents.
SAMPLE_ROWS = 6_000
POOL_ROWS = 6_000
ROUNDS = 4
#: Calibrated probability from which a view is confident, of either class.
CONFIDENT = 0.95
#: Pseudo-labels a view hands over in a round, per class.
HANDED = 300
#: Documents below are rejected.
THRESHOLD = 0.5
BINS = 8
PAGE_BUCKETS = 1 << 12

STATS = (
    "words", "word_length", "letters", "capitals", "digits", "space", "symbols", "distinct_words",
    "repeated_neighbours", "lines", "distinct_lines", "sentence_ends",
)

_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() or i >= 128 for i in range(256)])
_CAPITAL = np.array([65 <= i <= 90 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_END = np.array([chr(i) in ".!?" for i in range(256)])


def stats(text: bytes) -> list[float]:
    """The numbers of `STATS` for a text in UTF-8; bytes of other scripts count as letters."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words, lines = max(1, len(text)), text.split(), text.split(b"\n")
    letters, count = n[_LETTER].sum(), max(1, len(words))
    return [
        np.log1p(len(words)), (size - n[_SPACE].sum()) / count, letters / size, n[_CAPITAL].sum() / max(1, letters),
        n[_DIGIT].sum() / size, n[_SPACE].sum() / size, (size - letters - n[_DIGIT].sum() - n[_SPACE].sum()) / size,
        len(set(words)) / count, sum(map(operator.eq, words, words[1:])) / count,
        np.log1p(len(lines)), len(set(lines)) / len(lines), n[_END].sum() / count,
    ]


@dataclass
class TextView:
    """Each number as a step function: which of the sample's quantiles it lies between."""

    edges: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> TextView:
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        return cls(np.quantile(values, quantiles, axis=0).T if len(values) else np.zeros((len(STATS), BINS - 1)))

    def rows(self, values: np.ndarray) -> Rows:
        at = np.column_stack([np.searchsorted(e, values[:, j], "right") for j, e in enumerate(self.edges)])
        col = at + BINS * np.arange(len(self.edges))
        n, k = col.shape
        return Rows(k * np.arange(n + 1), col.ravel(), np.ones(n * k), k * BINS)


def page_rows(pages: pd.DataFrame) -> Rows:
    """Language, source and stated length (by powers of two), hashed; null is a value of its own."""
    length = pd.to_numeric(pages["n_chars"], errors="coerce")
    power = np.where(length.isna(), -1, np.floor(np.log2(length.fillna(0).clip(lower=0) + 1))).astype(int)
    kinds = [("lang", pages["lang"]), ("source", pages["source"]), ("length", pd.Series(power))]
    col = np.column_stack([
        [zlib.crc32(f"{name}={value}".encode()) % PAGE_BUCKETS for value in values] for name, values in kinds
    ]).reshape(len(pages), len(kinds))
    return Rows(len(kinds) * np.arange(len(pages) + 1), col.ravel().astype(np.int64), np.ones(col.size), PAGE_BUCKETS)


@dataclass
class Calibrated:
    """A model whose logits go through a line fitted on documents it has not seen."""

    model: Model
    slope: float
    shift: float

    def logit(self, rows: Rows) -> np.ndarray:
        return self.slope * self.model.logit(rows) + self.shift


def _dense(values: np.ndarray) -> Rows:
    n, k = values.shape
    return Rows(k * np.arange(n + 1), np.tile(np.arange(k), n), values.ravel().astype(float), k)


def _view(rows: Rows, y: np.ndarray, kept: Rows, kept_y: np.ndarray) -> Calibrated:
    model = fit(rows, y, l2=1e-3, steps=300)
    line = fit(_dense(model.logit(kept)[:, None]), kept_y, l2=1e-4, steps=300)
    return Calibrated(model, max(0.0, float(line.weights[0])), line.bias)


@dataclass
class CoTrained:
    view: TextView
    text: Calibrated
    page: Calibrated
    both: Model

    def scores(self, values: np.ndarray, pages: pd.DataFrame) -> np.ndarray:
        """rows × (text view, page view, both)."""
        views = np.column_stack([self.text.logit(self.view.rows(values)), self.page.logit(page_rows(pages))])
        return sigmoid(np.column_stack([views, self.both.logit(_dense(views))]))

    def score(self, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
        model = self

        @F.pandas_udf("text_score double, page_score double, score double")
        def of(texts: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
            values = np.array([stats(t) for t in texts], float).reshape(-1, len(STATS))
            pages = pd.DataFrame({"lang": lang, "source": source, "n_chars": n_chars}).reset_index(drop=True)
            return pd.DataFrame(model.scores(values, pages), columns=["text_score", "page_score", "score"])

        return of(body(text), lang.cast("string"), source.cast("string"), n_chars.cast("double"))


def _handed(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows a view is confident of, the surest of each class, and their labels."""
    chance = sigmoid(logit)
    order = np.argsort(-logit, kind="stable")
    good = order[:HANDED][chance[order[:HANDED]] >= CONFIDENT]
    poor = order[::-1][:HANDED]
    poor = poor[chance[poor] <= 1 - CONFIDENT]
    return np.concatenate([good, poor]), np.concatenate([np.ones(len(good)), np.zeros(len(poor))])


def _joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.start, a.start[-1] + b.start[1:]]), np.concatenate([a.col, b.col]),
                np.concatenate([a.value, b.value]), a.width)


def co_train(
    values: np.ndarray, pages: pd.DataFrame, y: np.ndarray, pool_values: np.ndarray, pool_pages: pd.DataFrame,
    rounds: int = ROUNDS,
) -> CoTrained:
    """Of ten labelled rows one is kept aside to calibrate the views, and another to weigh
    the calibrated views against each other."""
    view = TextView.of(np.concatenate([values, pool_values]))
    texts, metas = view.rows(values), page_rows(pages)
    pool_texts, pool_metas = view.rows(pool_values), page_rows(pool_pages)
    turn = np.arange(len(y)) % 10
    kept, weighed = turn == 0, turn == 5
    own = ~(kept | weighed)

    def fitted(rows: Rows, pool: Rows, given: tuple[np.ndarray, np.ndarray]) -> Calibrated:
        at, label = given
        return _view(_joined(rows.take(own), pool.take(at)), np.concatenate([y[own], label]), rows.take(kept), y[kept])

    nothing = (np.zeros(0, np.int64), np.zeros(0))
    to_text = to_page = nothing
    for _ in range(max(1, rounds)):
        text, page = fitted(texts, pool_texts, to_text), fitted(metas, pool_metas, to_page)
        to_text, to_page = _handed(page.logit(pool_metas)), _handed(text.logit(pool_texts))
    views = np.column_stack([text.logit(texts.take(weighed)), page.logit(metas.take(weighed))])
    return CoTrained(view, text, page, fit(_dense(views), y[weighed], l2=1e-3, steps=300))


PAGE = ("lang", "source", "n_chars")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, pool_rows: int = POOL_ROWS,
) -> CoTrained:
    prepared(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([stats(t) for t in texts])

    columns = {"text": body(F.col(text_col)), "lang": F.col("lang").cast("string"),
               "source": F.col("source").cast("string"), "n_chars": F.col("n_chars").cast("double")}
    sample = labelled_sample(docs, labels, id_col, columns, [label_col], sample_rows)
    order = F.xxhash64("_id")
    chosen = docs.select(F.col(id_col).alias("_id")).join(labels.select(F.col(id_col).alias("_id")), "_id", "left_anti")
    chosen = chosen.where("_id is not null").distinct().orderBy(order, "_id").limit(pool_rows)
    given = docs.select(F.col(id_col).alias("_id"), *(c.alias(f"_{n}") for n, c in columns.items()))
    pool = given.join(F.broadcast(chosen), "_id")  # `pool_rows` ids at most
    pool = one_each(pool).orderBy(order, "_id").limit(pool_rows)

    def got(df: DataFrame, *more: str) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
        rows = df.select(of("_text").alias("stats"), *(f"_{n}" for n in PAGE), *more).toPandas()
        values = np.array([list(s) for s in rows["stats"]], float).reshape(-1, len(STATS))
        return values, rows[[f"_{n}" for n in PAGE]].set_axis(list(PAGE), axis=1), rows

    values, pages, rows = got(sample, f"_{label_col}")
    return co_train(values, pages, rows[f"_{label_col}"].to_numpy(float), *got(pool)[:2])


def _scored(model: CoTrained) -> Column:
    return model.score(F.col("text"), *(F.col(n) for n in PAGE))


def without_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a score of `threshold` or more; all columns as they are.

    Null texts count as empty, null page columns as a value of their own. Without labels,
    or with labels of other documents only, all stay. Rows that repeat are each judged; no
    documents give no rows.
    """
    return docs.where(_scored(train(docs, labels))["score"] >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two views' scores of every document, their combination and whether it stays.

    Null texts count as empty, null page columns as a value of their own. Without
    labels every score is a half and every document stays. Rows that repeat are
    scored each time.
    """
    prepared(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", _scored(train(docs, labels)).alias("s")).select(
        "doc_id", "s.text_score", "s.page_score", "s.score", (F.col("s.score") >= THRESHOLD).alias("keep"))
