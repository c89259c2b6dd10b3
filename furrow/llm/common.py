"""What the operators share: the documents table, words, and helpers of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.operators.numbering import row_numbers
from furrow.session import own_dir, scratch, shared_dir, sized, stored

__all__ = ["Remembered", "WORD_BREAK_JAVA", "documents", "own_dir", "row_numbers", "scratch", "shared_dir", "sized", "stored"]

#: Word separators: space and \t \n \v \f \r.
WORD_BREAK_JAVA = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Remembered(dict):
    """``of(word)`` by word; forgets all of it beyond ``most`` words, which changes no result."""

    def __init__(self, of, most: int = 100_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        value = self[word] = self.of(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
