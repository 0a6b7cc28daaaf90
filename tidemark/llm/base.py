"""What several operators share: tables, checkpoints, labelled samples, word rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import cut, shared_folder  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own from the shared store."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)


def free(columns, *names: str) -> list[str]:
    """``names``, each lengthened until no column is called so: for columns that a step adds for its own use."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame, seed: str = "row") -> Column:
    """A hash of all columns of a row; rows that are alike in all columns have the same."""
    plain = lambda t: "map<" not in t and "variant" not in t
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") if plain(t) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, t in df.dtypes])


def slices(batches, rows: int = 2000, mb: int = 32):
    """Arrow batches of at most ``rows`` rows and about ``mb`` MB each, so that long texts don't fill a worker."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * (mb << 20) // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(*cols: str, seed: int = 0) -> Column:
    """A deterministic number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, label: str, per_class: int, max_chars: int, max_classes: int = 500) -> list[tuple]:
    """Rows (text, label, lang) for fitting on the driver: about ``per_class`` of each class.

    The class sizes are counted over all rows; then rows are kept by a hash of doc_id and text, so the
    sample is the same on every run and its size is bounded by per_class * max_classes whatever the
    input. Texts longer than ``max_chars`` aren't used for fitting (they are scored like any other).
    Equal rows count once. The most frequent ``max_classes`` classes take part. Null texts and labels are left out.
    """
    docs = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    sizes = docs.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_classes).collect()
    if not sizes:
        return []
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col(label) == row[0], F.lit(per_class / row[1])).otherwise(share)
    rows = docs.filter(uniform("doc_id", "text") < share).select("text", label, "lang" if label != "lang" else F.lit(None).alias("l")).distinct().collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], str(r[1]), str(r[2])))


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int, max_chars: int, max_classes: int = 100) -> tuple[list[tuple], dict]:
    """Rows (text, label, lang) for fitting on the driver, and the number of labels of each class.

    Ids are drawn by hash, about ``per_class`` of each of the ``max_classes`` most frequent classes, and an id
    gives one of its rows (the least by a hash of the text), so what is sent to all executors and collected has a
    bound even if one id holds a third of all rows. Texts longer than ``max_chars`` and classes beyond
    ``max_classes`` don't take part in fitting; the class sizes count all labels.
    """
    labels = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("_label")).distinct()
    sizes = {r[0]: r[1] for r in labels.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(max_classes).collect()}
    if not sizes:
        return [], sizes
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("_label") == value, F.lit(per_class / n)).otherwise(share)
    ids = labels.filter(uniform("doc_id") < share)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang")).filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("r")
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_label").agg(one).select("r.text", "_label", "r.lang").collect()
    return sorted(set(map(tuple, rows)), key=lambda r: (r[0], r[1], str(r[2]))), sizes


class WordRows:
    """Rows of numbers by word, made once for each distinct word that a worker meets.

    ``make`` turns a list of words into a float32 array with a row each. Beyond ``limit`` words the
    rows are forgotten and made anew, so memory stays bounded whatever the vocabulary.
    """

    def __init__(self, make, limit: int = 200_000):
        self.make, self.limit = make, limit
        self.known: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def ids(self, words: list[str]) -> np.ndarray:
        """A row number for each word. Row 0 is all zeros and stands for no word."""
        missing = list(set(words).difference(self.known))
        if missing and len(self.known) + len(missing) > self.limit:
            self.known, self.rows = {}, None
            missing = list(set(words))
        if self.rows is None:
            self.rows = np.zeros_like(self.make([""]))[:1]
            self.used = 1
        if missing:
            need = self.used + len(missing)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]), self.rows.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            for at in range(0, len(missing), 20_000):
                part = missing[at : at + 20_000]
                self.rows[self.used : self.used + len(part)] = self.make(part)
                self.known.update(zip(part, range(self.used, self.used + len(part)), strict=True))
                self.used += len(part)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
