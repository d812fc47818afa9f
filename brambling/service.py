"""A facade over the engine: build and search, with rows and elapsed milliseconds."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brambling.functions import sift
from brambling.operators import text_search, visual_search
from brambling.operators.visual_index import VisualIndex
from brambling.sources.tables import IndexStore, decode_image, extract_descriptors, read_corpus_csv, read_images

#: Fixed value: the method that compares with every image; any other word asks the inverted index.
SEQUENTIAL = "secuencial"


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, IndexStore(spark, root)

    def build_text(self, name: str, csv_path: str, id_column: int, text_column: int) -> dict:
        """Builds and stores an index from a CSV file, in place of an older one of that name."""
        self.store.save_text(name, read_corpus_csv(self.spark, csv_path, id_column, text_column))
        return {"message": f"index {name} is built"}

    def search_text(self, query: str, k: int = 10, name: str = "songs") -> dict:
        """The best documents with snippets. No words, an unknown index and unknown words give none."""
        began = time.perf_counter()
        rows: list = []
        words = text_search.analysed(self.spark, query, stem=True)
        if words and self.store.exists(name):
            index = self.store.load(name)
            rows = [r.asDict() for r in text_search.with_snippets(text_search.search(index, words, k), index, list(words)).collect()]  # k rows
        rows.sort(key=lambda r: (-r["score"], r["doc_id"]))
        return {"results": rows, "execution_time": round((time.perf_counter() - began) * 1000, 3)}

    def build_images(self, name: str, folder: str, k: int = 1000, sample_images: int = 3000, n_features: int = 100) -> dict:
        """Extracts the descriptors of a folder's images, trains a codebook unless the index has one, and stores the index."""
        images = read_images(self.spark, folder)
        found = extract_descriptors(images, lambda grey: sift.descriptors(grey, n_features))
        with self.store.scratch(name, found) as written:
            self.store.save_visual(name, written, images=images, k=k, sample_images=sample_images)
        return {"message": f"index {name} is built"}

    def search_image(self, content: bytes, metadata: DataFrame, k: int = 8, method: str = "inverted", name: str = "images", n_features: int = 100) -> dict:
        """The images most like an uploaded file's; one that cannot be decoded or has no features gives none."""
        grey = decode_image(self.spark, content)
        found = None if grey is None else sift.descriptors(grey, n_features)
        if found is None:
            return {"results": []}
        return self.search_descriptors(self.spark.createDataFrame(pa.table({"vec": found.tolist()})), self.store.load_visual(name), metadata, k, method)

    def search_descriptors(self, descriptors: DataFrame, index: VisualIndex, metadata: DataFrame, k: int = 8, method: str = "inverted") -> dict:
        hits = visual_search.search(descriptors, index, k, "sequential" if method == SEQUENTIAL else method)
        rows = [r.asDict() for r in visual_search.format_hits(hits, metadata).collect()]  # k rows
        return {"results": sorted(rows, key=lambda r: (-r["score"], r["id"]))}


def index_sizes(store: IndexStore, name: str, kind: str = "text") -> dict:
    """Rows of each table of a stored index."""
    return {table: rows for table, (rows, _) in store.sizes(name, kind).items()}


def build_with_statistics(store: IndexStore, name: str, docs: DataFrame, stem: bool = True) -> dict:
    """Builds a text index and says how long it took, what its tables measure and how many megabytes a second that makes."""
    began = time.perf_counter()
    store.save_text(name, docs, stem)
    seconds = time.perf_counter() - began
    sizes = store.sizes(name)
    megabytes = {table: n / 2**20 for table, (_, n) in sizes.items()}
    return {"seconds": seconds, "megabytes": megabytes, "rows": {t: n for t, (n, _) in sizes.items()}, "throughput": (megabytes["dictionary"] + megabytes["postings"]) / seconds}
