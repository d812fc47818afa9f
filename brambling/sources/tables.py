"""Readers of corpora, metadata and images, and the store of named indexes."""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brambling.functions import sift
from brambling.operators import text_index, visual_index
from brambling.operators.text_index import TextIndex
from brambling.operators.visual_index import VisualIndex

_NAME = re.compile(r"[A-Za-z0-9_-]+")


def read_corpus_csv(spark: SparkSession, path: str, id_column: int, text_column: int, name_column: str = "track_name") -> DataFrame:
    """doc_id, text, name, ord from a CSV file with a header, its columns chosen by place; negative places count from the end. ord is the order in the files."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    columns = raw.columns
    name = F.col(f"`{name_column}`") if name_column in columns else F.lit(None)
    return raw.select(
        F.col(f"`{columns[id_column]}`").cast("string").alias("doc_id"),
        F.col(f"`{columns[text_column]}`").alias("text"),
        name.cast("string").alias("name"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("ord"),
    )


def read_corpus_parquet(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", name: str | None = "source") -> DataFrame:
    shown = F.col(name).cast("string") if name else F.lit(None).cast("string")
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), shown.alias("name"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """id, title, gender, year of products; malformed lines are skipped, of several rows of an id one stays."""
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    return raw.select(F.col("id").cast("string").alias("id"), F.col("productDisplayName").alias("title"), "gender", "year").dropDuplicates(["id"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the file's name), height, width, channels and samples of the .jpg files directly in a folder; files that cannot be decoded have no samples."""
    files = spark.read.format("image").option("pathGlobFilter", "*.jpg").load(path)
    return files.select(F.element_at(F.split("image.origin", "/"), -1).alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def decode_image(spark: SparkSession, content: bytes) -> np.ndarray | None:
    """The grey image of a file's bytes, as of an upload; None if they cannot be decoded."""
    reader = getattr(getattr(spark._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    found = reader.decode("upload", bytearray(content))
    if found.isEmpty():
        return None
    image = found.get().getStruct(0)
    return sift.to_grey(bytes(image.get(5)), image.getInt(1), image.getInt(2), image.getInt(3))


def _safe(extractor: Callable, *image) -> np.ndarray:
    """The extractor's vectors; an image that it cannot read, for whatever reason, has none."""
    try:
        grey = sift.to_grey(*image)
        found = None if grey is None else extractor(grey)
    except Exception:
        found = None
    return np.zeros((0, 0), np.float32) if found is None else np.asarray(found, np.float32)


def extract_descriptors(images: DataFrame, extractor: Callable[[np.ndarray], np.ndarray | None] = sift.descriptors) -> DataFrame:
    """image_id, ord, vec of decoded images: extractor(grey image) gives an image's vectors, or None where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, *sizes = (c.to_pylist() for c in batch.columns[1:])
            found = [_safe(extractor, *image) for image in zip(data, *sizes)]
            count = [len(f) for f in found]
            width = np.repeat([f.shape[1] for f in found], count)
            flat = np.concatenate([np.zeros(0, np.float32), *(f.ravel() for f in found)])
            vec = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), pa.array(flat, pa.float32()))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), count)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for n in count for i in range(n)], pa.int32()), vec], ["image_id", "ord", "vec"])

    rows = images.select("image_id", "data", "height", "width", "channels")
    return rows.mapInArrow(run, "image_id string, ord int, vec array<float>").withColumn("vec", F.col("vec").cast("array<double>"))


def write_prefixes(df: DataFrame, key: str, sizes: list[int], folder: str) -> None:
    """CSV files of the first n rows by key."""
    for n in sizes:
        df.orderBy(key).limit(n).write.mode("overwrite").csv(f"{folder}/prefix_{n}", header=True)


class IndexStore:
    """Named indexes as Parquet tables.

    Each save is a version of its own, published by a marker when all its tables
    are written; readers take the newest published one, and the one before it
    stays for those who still read it. Each file of postings and dictionary is sorted
    by term (or word), so that a lookup reads few pages. Tables are derived from each
    other as written: a corpus is analysed once.
    """

    kinds = {"text": TextIndex, "visual": VisualIndex}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, *parts: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not an index name: {name!r}")
        return "/".join([self.root, name, *parts])

    def _files(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str, kind: str) -> list[str]:
        fs, p = self._files(self._path(name, kind, "*", "_PUBLISHED"))
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])

    def _write(self, df: DataFrame, folder: str, table: str, order: tuple[str, ...] = ()) -> DataFrame:
        path = f"{folder}/{table}"
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish(self, name: str, kind: str, folder: str, tables: dict[str, DataFrame]) -> None:
        old = self._versions(name, kind)
        fs, p = self._files(f"{folder}/_PUBLISHED")
        out = fs.create(p)
        out.write(bytearray(json.dumps({table: df.schema.jsonValue() for table, df in tables.items()}).encode()))
        out.close()
        for version in old[:-1]:
            fs.delete(self._files(self._path(name, kind, version))[1], True)

    def _new(self, name: str, kind: str) -> str:
        return self._path(name, kind, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")

    @contextlib.contextmanager
    def scratch(self, name: str, df: DataFrame) -> Iterator[DataFrame]:
        """df as a written table, for as long as it is used."""
        folder = self._new(name, "scratch")
        try:
            yield self._write(df, folder, "rows")
        finally:
            fs, p = self._files(folder)
            fs.delete(p, True)

    def save_text(self, name: str, docs: DataFrame, stem: bool = True, stopwords: tuple[str, ...] | None = None) -> TextIndex:
        """Builds the index of a corpus and writes it, in place of an older one of that name."""
        folder = self._new(name, "text")
        rows = text_index.n_build(docs)
        with self.scratch(name, text_index.document_words(docs, stem, stopwords)) as words:
            terms = self._write(text_index.dictionary(text_index.flat_words(words), rows), folder, "dictionary", ("term",))
            lengths = self._write(text_index.document_norms(words, terms), folder, "norms")
            flat = self._write(text_index.laid_out(words, terms, lengths), folder, "postings")
        sizes = self._write(text_index.stats(rows, lengths, terms), folder, "stats")
        shown = self._write(text_index.last_rows(docs), folder, "documents")
        self._publish(name, "text", folder, TextIndex(shown, terms, flat, lengths, sizes)._asdict())
        return self.load(name)

    def save_visual(self, name: str, descriptors: DataFrame, codebook: DataFrame | None = None, images: DataFrame | None = None, **training) -> VisualIndex:
        """Builds the index of images and writes it. Without a codebook that of the index's last version is used again, and one is trained if there is none."""
        if codebook is None:
            codebook = self.load_visual(name).codebook if self.exists(name, "visual") else visual_index.train_codebook(descriptors, **training)
        folder = self._new(name, "visual")
        images = descriptors.select("image_id").distinct() if images is None else images.select("image_id").distinct()
        book = self._write(codebook, folder, "codebook")
        hist = self._write(visual_index.histograms(visual_index.assign_words(descriptors, book)), folder, "histograms", ("image_id", "word"))
        idf = self._write(visual_index.visual_idf(hist, book, images), folder, "idf")
        weighted = visual_index.visual_weights(hist, idf)
        lengths = self._write(visual_index.visual_norms(weighted, images), folder, "norms")
        flat = self._write(visual_index.visual_postings(weighted, lengths), folder, "postings", ("word", "image_id"))
        self._publish(name, "visual", folder, VisualIndex(book, hist, idf, flat, lengths)._asdict())
        return self.load_visual(name)

    def _load(self, name: str, kind: str):
        tables = self.kinds[kind]
        versions = self._versions(name, kind)
        if not versions:
            raise FileNotFoundError(f"no {kind} index {name!r}")
        fs, p = self._files(self._path(name, kind, versions[-1], "_PUBLISHED"))
        stream = fs.open(p)
        schemas = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return tables(*(self.spark.read.schema(StructType.fromJson(schemas[t])).parquet(self._path(name, kind, versions[-1], t)) for t in tables._fields))

    def load(self, name: str) -> TextIndex:
        return self._load(name, "text")

    def load_visual(self, name: str) -> VisualIndex:
        return self._load(name, "visual")

    def exists(self, name: str, kind: str = "text") -> bool:
        return bool(self._versions(name, kind))

    def sizes(self, name: str, kind: str = "text") -> dict[str, tuple[int, int]]:
        """Rows and bytes of each table."""
        version = self._versions(name, kind)[-1]
        out = {}
        for table, df in self._load(name, kind)._asdict().items():
            fs, p = self._files(self._path(name, kind, version, table))
            out[table] = (df.count(), fs.getContentSummary(p).getLength())
        return out

    def dictionary_lookup(self, name: str, terms: list[str]) -> DataFrame:
        return self.load(name).dictionary.filter(F.col("term").isin(terms))

    def postings_batch(self, name: str, terms: list[str]) -> DataFrame:
        return self.load(name).postings.filter(F.col("term").isin(terms))
