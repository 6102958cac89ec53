"""Categorical columns: common categories, ordinal and one-hot codes, count vectors."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.features.base import (
    ColumnEstimator,
    ColumnModel,
    Param,
    Params,
    TypeConverters,
    keyword_only,
)
from ebbtide.functions.running import running_totals
from ebbtide.operators.frequencies import value_frequencies

OTHER = "other"


def common_categories(
    df: DataFrame, columns: list[str], threshold: float = 0.8, order: str = "value"
) -> DataFrame:
    """(column, value, cnt, share) of the categories whose running share stays below the threshold.

    `order='value'` accumulates in alphabetic order, `order='frequency'` from the most to
    the least frequent category.
    """
    freq = value_frequencies(df, columns).where(F.col("value").isNotNull())
    running = running_totals(
        freq,
        "value" if order == "value" else "cnt",
        {"cnt": "_upto"},
        by=["column"],
        ties=["value"],
        descending=order != "value",
        totals={"cnt": "_total"},
    )
    return (
        running.withColumn("share", F.col("_upto") / F.col("_total"))
        .where(F.col("share") < threshold)
        .select("column", "value", "cnt", "share")
    )


class CommonCategories(ColumnEstimator):
    """Keep common categories, replace all others by 'other'.

    NULL stays NULL, so that an imputer can follow; put it in front to count NULL's
    replacement as a category.
    """

    threshold = Param(Params._dummy(), "threshold", "strict upper share", TypeConverters.toFloat)
    order = Param(Params._dummy(), "order", "value or frequency", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, threshold=0.8, order="value"):
        super().__init__()
        self._setDefault(threshold=0.8, order="value")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CommonCategoriesModel":
        columns = [c for c, _ in self.pairs()]
        kept = common_categories(
            df, columns, self.getOrDefault(self.threshold), self.getOrDefault(self.order)
        )
        # the kept values become part of the model, as the labels of an indexer do
        lists = {
            r["column"]: sorted(r["values"])
            for r in kept.groupBy("column").agg(F.collect_list("value").alias("values")).collect()
        }
        model = CommonCategoriesModel(kept=[lists.get(c, []) for c in columns])
        return self._copy_columns_to(model)


class CommonCategoriesModel(ColumnModel):
    kept = Param(Params._dummy(), "kept", "kept categories per column", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, kept=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, column: str, position: int):
        kept = self.getOrDefault(self.kept)[position]
        value = F.col(column)
        return F.when(value.isNull() | value.isin(*kept), value).otherwise(F.lit(OTHER))


def recode_other(df: DataFrame, column: str, kept: DataFrame, out: str | None = None) -> DataFrame:
    """The same with the kept categories (one column `value`) as a table, for long lists."""
    known = kept.select(F.col("value").alias("_kept")).distinct()
    recoded = F.when(F.col("_kept").isNull() & F.col(column).isNotNull(), F.lit(OTHER)).otherwise(
        F.col(column)
    )
    return (
        df.join(known, F.col(column) == F.col("_kept"), "left")
        .withColumn(out or column, recoded)
        .drop("_kept")
    )


def ordinal_indexer(columns: list[str], outputs: list[str], unknown: str = "error") -> StringIndexer:
    """Codes 0...k-1 in alphabetic order."""
    return StringIndexer(
        inputCols=columns,
        outputCols=outputs,
        stringOrderType="alphabetAsc",
        handleInvalid=unknown,
    )


def onehot_stages(columns: list[str], unknown: str = "ignore") -> list:
    """Alphabetic one-hot vectors `<column>_onehot`.

    With `unknown='ignore'` the indexer keeps a last slot for unseen and missing values,
    and the encoder drops just this slot, so they get the zero vector.
    """
    indexed = [f"{c}_index" for c in columns]
    vectors = [f"{c}_onehot" for c in columns]
    keep = unknown == "ignore"
    return [
        ordinal_indexer(columns, indexed, "keep" if keep else "error"),
        OneHotEncoder(
            inputCols=indexed, outputCols=vectors, dropLast=keep, handleInvalid="error"
        ),
    ]


class TokenVectorizer(ColumnEstimator):
    """Counts of the most frequent tokens of each text column.

    Tokens are what stands between separators. The `sizes[i]` tokens with the highest total
    frequency (ties: the smaller token) form the vocabulary, in alphabetic order. Output
    columns are arrays, or 0/1 arrays when `binary`.
    """

    sizes = Param(Params._dummy(), "sizes", "vocabulary size per column", TypeConverters.toListInt)
    separator = Param(Params._dummy(), "separator", "between tokens", TypeConverters.toString)
    lowercase = Param(Params._dummy(), "lowercase", "lower the text", TypeConverters.toBoolean)
    binary = Param(Params._dummy(), "binary", "0/1 instead of counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, sizes=None, separator="\n", lowercase=True,
        binary=False,
    ):
        super().__init__()
        self._setDefault(separator="\n", lowercase=True, binary=False)
        self._set(**self._input_kwargs)

    def vocabulary(self, df: DataFrame) -> DataFrame:
        """(column, token, frequency, index): the vocabularies as a table."""
        parts = []
        for (column, _), size in zip(self.pairs(), self.getOrDefault(self.sizes)):
            tokens = F.explode(
                _tokens(column, self.getOrDefault(self.separator), self.getOrDefault(self.lowercase))
            )
            top = (
                df.select(tokens.alias("token"))
                .groupBy("token")
                .agg(F.count("*").alias("frequency"))
                .orderBy(F.col("frequency").desc(), "token")
                .limit(size)
            )
            words = top.agg(
                F.array_sort(F.collect_list(F.struct("token", "frequency"))).alias("words")
            )
            parts.append(
                words.select(F.lit(column).alias("column"), F.posexplode("words")).select(
                    "column",
                    F.col("col.token").alias("token"),
                    F.col("col.frequency").alias("frequency"),
                    F.col("pos").alias("index"),
                )
            )
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part)
        return stacked

    def _fit(self, df: DataFrame) -> "TokenVectorizerModel":
        words: dict[str, list[str]] = {c: [] for c, _ in self.pairs()}
        for row in self.vocabulary(df).orderBy("column", "index").collect():
            words[row["column"]].append(row["token"])
        model = TokenVectorizerModel(
            words=[words[c] for c, _ in self.pairs()],
            separator=self.getOrDefault(self.separator),
            lowercase=self.getOrDefault(self.lowercase),
            binary=self.getOrDefault(self.binary),
        )
        return self._copy_columns_to(model)


def _tokens(column: str, separator: str, lowercase: bool):
    text = F.lower(column) if lowercase else F.col(column)
    return F.split(text, f"\\Q{separator}\\E")


class TokenVectorizerModel(ColumnModel):
    words = Param(Params._dummy(), "words", "vocabulary per column", TypeConverters.identity)
    separator = Param(Params._dummy(), "separator", "between tokens", TypeConverters.toString)
    lowercase = Param(Params._dummy(), "lowercase", "lower the text", TypeConverters.toBoolean)
    binary = Param(Params._dummy(), "binary", "0/1 instead of counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, words=None, separator="\n", lowercase=True,
        binary=False,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, column: str, position: int):
        tokens = _tokens(
            column, self.getOrDefault(self.separator), self.getOrDefault(self.lowercase)
        )
        binary = self.getOrDefault(self.binary)

        def cell(word: str):
            if binary:
                found = F.array_contains(tokens, word)
            else:
                found = F.size(F.filter(tokens, lambda t: t == word))
            # a missing text has no tokens; the size of a missing array may be -1
            return F.when(tokens.isNotNull(), found.cast("double")).otherwise(F.lit(0.0))

        cells = [cell(word) for word in self.getOrDefault(self.words)[position]]
        return F.array(*cells) if cells else F.array().cast("array<double>")
