"""Documents, labels and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.functions.arrays import sums_before


def exploded_lines(documents: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep..., line_no, line, offset): a row for each line with a sign other than whitespace.

    Lines end at a newline; empty and blank ones are left out but move the offset on. Null texts have no lines.
    Offsets are summed within the row before the lines come apart, so nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n", -1)
    offsets = sums_before(F.transform(lines, lambda x: F.length(x) + 1))
    rows = documents.where(F.col(text).isNotNull()).select(key, *keep, lines.alias("_lines"), offsets.alias("_offsets"))
    rows = rows.select(key, *keep, F.posexplode(F.arrays_zip("_lines", "_offsets")).alias("line_no", "_l"))
    return rows.select(key, *keep, "line_no", F.col("_l._lines").alias("line"), F.col("_l._offsets").alias("offset")).where(F.col("line").rlike(r"\S"))


def label_view(documents: DataFrame, labels: list[str] | None, label: str = "label") -> DataFrame:
    """The documents with one of *labels*, case ignored; all for None."""
    return documents if labels is None else documents.where(F.lower(label).isin([x.lower() for x in labels]))


def missing_labels(documents: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """(label): those of *labels* that no document has."""
    spark = documents.sparkSession
    asked = spark.createDataFrame([(x.lower(),) for x in dict.fromkeys(labels)], "label string")
    return asked.join(documents.select(F.lower(label).alias("label")).distinct(), "label", "left_anti")


def with_labels(documents: DataFrame, labels: DataFrame, stem: str = "name", default: str = "None") -> DataFrame:
    """*documents* with the label of their stem from *labels* (name, label; the smallest of several), else *default*."""
    one = labels.where("name is not null").groupBy(F.col("name").alias(stem)).agg(F.min("label").alias("found_label"))
    return documents.join(one, stem, "left").withColumn("found_label", F.coalesce("found_label", F.lit(default)))


def stratified(documents: DataFrame, key: str, label: str, total: int, seed: int = 0) -> DataFrame:
    """floor(total / labels) documents of each label (null is none), chosen by a seeded hash of their key."""
    some = documents.where(F.col(label).isNotNull()).withColumn("stratum", F.lower(label))
    each = F.floor(F.lit(total) / F.greatest(F.lit(1), F.lit(some.select("stratum").distinct().count())))
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed))), key)
    return some.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= each).drop("nr")


def hit_id(other: Column, own: Column, stored: Column) -> Column:
    """The id of a hit: another field's if it is not empty, else its own, else the store's."""
    return F.coalesce(F.nullif(other, F.lit("")), F.nullif(own, F.lit("")), stored)


def name_filter(documents: DataFrame, parts: list[str], inverse: bool = False, name: str = "name") -> DataFrame:
    """Leaves out documents whose name contains one of *parts*, case ignored (with *inverse*: contains none); nameless ones stay."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(F.lower(name), F.lit(p.lower()))
    return documents.where(F.col(name).isNull() | (F.col(name) == "") | (hit if inverse else ~hit))


def corpus_statistics(documents: DataFrame, phrases: DataFrame, label: str = "label") -> DataFrame:
    """One row: documents, labelled documents, distinct labels, phrases."""
    docs = documents.agg(F.count("*").alias("n_documents"), F.count(label).alias("n_labels"), F.countDistinct(F.lower(label)).alias("n_label_types"))
    return docs.crossJoin(phrases.agg(F.count("*").alias("n_phrases")))  # one row by one row


def lookup(documents: DataFrame, by: str, values: list, *wanted: str) -> DataFrame:
    """(by, wanted...) of the documents whose *by* is one of *values*: ids of names, names of ids, documents by id or name."""
    return documents.where(F.col(by).isin(values)).select(by, *wanted)


def of_label(documents: DataFrame, label_value: str, wanted: str, label: str = "label") -> DataFrame:
    """The distinct *wanted* of the documents with a label, case ignored, nulls left out, in order."""
    rows = documents.where((F.lower(label) == label_value.lower()) & F.col(wanted).isNotNull())
    return rows.select(wanted).distinct().orderBy(wanted)


class View:
    """What a label view shows of a corpus: its documents, labels, names and counts. If *strict*, labels that no document has are an error."""

    def __init__(self, documents: DataFrame, labels: list[str] | None = None, label: str = "label", strict: bool = True):
        if labels is not None and strict:
            missing = [r.label for r in missing_labels(documents, labels, label).collect()]  # at most the labels asked for
            if missing:
                raise KeyError(", ".join(sorted(missing)))
        self.label, self.documents = label, label_view(documents, labels, label)

    def labels(self) -> DataFrame:
        """Each document's label."""
        return self.documents.select(self.label)

    def topics(self) -> DataFrame:
        """The distinct labels, in lower case."""
        return self.documents.where(F.col(self.label).isNotNull()).select(F.lower(self.label).alias(self.label)).distinct()

    def size(self) -> int:
        return self.documents.count()

    def of(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """The rows of lines, chunks or occurrences that belong to documents of the view."""
        return rows.join(self.documents.select(key).distinct(), key, "left_semi")
