"""Token counts behind a digest cache, and fast exact word-wise encoding.

Texts are cut at single spaces and line feeds where the tokenizer is known
to cut too, and each distinct piece is encoded once per worker by the
tokenizers library itself: plain words by its model, others in full. Where
spaces belong to pieces, texts with neighbouring white space, or white space
at an end, go to the library whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, held, materialise, release, small_batches, table_path

#: Pieces of either kind that a worker remembers.
PIECES = 600_000
#: White space that Python knows and the tokenizers do not, and white space other than single spaces and line feeds.
SEPARATORS = re.compile("[\x1c-\x1f]")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Marks at the end of a word that both tokenizers part from its letters.
TAIL = ".,;:!?\")]}#$%&*"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PieceEncoder:
    """Encodes by pieces. space_joins: a piece keeps the space before it (byte-level); else white space is dropped by the tokenizer.

    value turns a piece's ids into something that `join` puts together for a text.
    """

    def __init__(self, path: str, space_joins: bool, value, join):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model, self.letters = self.library.model, byte_letters()
        self.space_joins, self.value, self.join = space_joins, value, join
        self.bare, self.spaced = (Remembered(lambda p, space=space: self._find(p, space), PIECES) for space in (False, True))

    @classmethod
    def of(cls, path: str, space_joins: bool, value, join) -> "PieceEncoder":
        return held((path, space_joins, value), lambda: cls(path, space_joins, value, join))

    def _plain(self, core: str) -> bool:
        """Whether the word is letters alone that the model may be asked for directly."""
        if not core.isalpha() or len(core) >= 100:
            return False
        if core.isascii() or self.space_joins:
            return True
        return unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", core.lower()) and "\u03a3" not in core and "\u0130" not in core

    def _find(self, piece: str, space: bool):
        own, core = self.spaced if space else self.bare, piece.rstrip(TAIL)
        if not self._plain(core):
            return self.value(self.library.encode(" " + piece if space else piece, add_special_tokens=False).ids)
        if len(core) < len(piece):
            return own[core] + self.bare[piece[len(core) :]]
        if not self.space_joins and core != (low := core.lower()):
            return own[low]
        raw = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
        return self.value([t.id for t in self.model.tokenize("\u0120" + raw if space else raw)])

    def _whole(self, text: str):
        return self.join((self.value(self.library.encode(text, add_special_tokens=False).ids),))

    def encode(self, text: str):
        """The text's value."""
        if not text:
            return self.join(())
        if not self.space_joins:
            return self._whole(text) if SEPARATORS.search(text) else self.join(map(self.bare.__getitem__, text.split()))
        if OTHER_SPACE.search(text):
            return self._whole(text)
        parts = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:  # neighbouring white space, or white space at an end
                return self._whole(text)
            if i:
                parts.append(self.bare["\n"])
            parts.append(self.bare[words[0]])
            parts += map(self.spaced.__getitem__, words[1:])
        return self.join(parts)


def slices(batch: pa.RecordBatch, rows: int = 256):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str | None = None, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens), one row for each input row; null texts count as empty. An empty table gives no rows.

    The normalised content is the text with null as ''; nothing else may
    change, as any change could alter the count. Its SHA-256 and the
    tokenizer version's digest - that of the tokenizer's file unless a
    version is given - are the cache key. Counts already in the
    Parquet table cache_path are joined; only distinct misses are encoded, then
    appended there (a fresh table in the shared folder if no path is given).
    Texts travel Zstandard-compressed, at most once from each partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = cache_path or table_path(spark, "counts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    tag = F.sha2(F.lit(version or file_digest(tokenizer_path)), 256)
    schema = "digest binary, tokenizer string, n_tokens long"
    todo = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    if cache_path and _exists(spark, cache_path):
        stored = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == tag).select("digest").distinct()
        todo = todo.join(materialise(stored, "stored"), "digest", "left_anti")

    def pack(batches):
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            at = []
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    at.append(i)
            kept = b.take(pa.array(at, pa.int64()))
            texts = [press.compress(t) for t in kept.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(texts, pa.binary())], names=["digest", "packed"])

    def encode(batches):
        coder, press, seen = PieceEncoder.of(tokenizer_path, True, len, sum), zstandard.ZstdDecompressor(), set()
        for b in batches:
            for s in slices(b):
                ds, counts = [], []
                for d, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    if d not in seen:
                        seen.add(d)
                        ds.append(d)
                        counts.append(coder.encode(press.decompress(t).decode() if t else ""))
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])
        release()

    packed = todo.mapInArrow(pack, "digest binary, packed binary").repartition(F.col("digest"))
    counted = packed.mapInArrow(encode, "digest binary, n_tokens long")
    counted.select("digest", tag.alias("tokenizer"), "n_tokens").write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).where(F.col("tokenizer") == tag)
    # written first, so that the join below is one of two plain shuffles, which can part a digest that very many rows share
    known = materialise(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    return keyed.join(known, "digest", "left").select("id", "n_bytes", "n_tokens")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
