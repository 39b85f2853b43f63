"""SentencePiece encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, named, ship, slices

ship(__name__)
MARK = "▁"
#: A chunk: marks, then text up to the next mark. Every text starts with the mark that encoding adds.
CHUNK = re.compile(" +[^ ]*")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Distinct chunks with their ids, as ``(ids, ids as text, decoded)``.

    Valid for a model whose pieces have marks only at their start, which is checked, that adds a
    mark before the text and changes no character: no merge then crosses into the next mark, so a
    text's ids are those of its chunks in order. The table keeps ``most`` chunks and starts anew
    beyond that, which changes how often a chunk is segmented but no result.
    """

    def __init__(self, model: str, most: int = 300_000) -> None:
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.sp.get_piece_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError(f"piece {i} holds a mark after other characters")
        self.most, self.table = most, {}
        probe = " a  bc \nd "
        self.learn([self.chunks(probe)])
        if ",".join(self.table[c][1] for c in self.chunks(probe)) != ",".join(map(str, self.sp.encode(probe))):
            raise ValueError("the model changes white space or adds no mark")

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the chunks of these texts that are not known yet, each once."""
        if len(self.table) > self.most:
            self.table = {}
        table = self.table
        new = list({c for chunks in texts for c in chunks if c not in table})
        for c, ids in zip(new, self.sp.encode([c[1:] or " " for c in new], num_threads=1), strict=True):
            if c == " ":            # a last mark alone: the mark that encoding adds is this one
                ids = [self.sp.piece_to_id(MARK)]
            table[c] = (len(ids), ",".join(map(str, ids)), self.decoded(ids))

    def decoded(self, ids: list[int]) -> str:
        """The text of a chunk inside a document; decoding drops the first mark of what it is given."""
        return " " + self.sp.decode(ids)


def encode_batches(model: str, text: str, out: dict[str, pa.DataType], make):
    """Arrow stage: columns ``out`` of ``make(chunk rows)`` per text, beside the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                split = [table.chunks(t or "") for t in batch.column(text).to_pylist()]
                table.learn(split)
                known = table.table
                made = [make([known[c] for c in chunks]) for chunks in split]
                keep = [i for i, n in enumerate(batch.schema.names) if n != text]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(out.values())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *columns],
                                                 names=[*[batch.schema.names[i] for i in keep], *out])

    return run


def digests(rows: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    ids = ",".join([r[1] for r in rows])
    text = "".join([r[2] for r in rows])[1:]
    return (sum([r[0] for r in rows]), hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def id_list(rows: list[tuple[int, str, str]]) -> tuple[list[int]]:
    return ([int(i) for r in rows for i in r[1].split(",")],)


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; the digest of ids is that of
    their decimals joined by commas, the digest of the decoded text that of its UTF-8.

    A null or empty text has no ids and decodes to the empty text. Repeated rows repeat. A null id
    stays null. Very long texts are encoded whole; a text without white space is one chunk.
    """
    own = boxed(docs, doc_id=doc_id, text=text).select("doc_id", "text")
    out = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = own.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
                        F.lit("").alias("decoded_sha256")).schema
    return own.mapInArrow(encode_batches(model or model_path(), "text", out, digests), schema)


def encode_ids(docs: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the column ``out`` (array of int) in place of ``text``."""
    if out in docs.columns:
        raise ValueError(f"the table has a column {out} already")
    rest = [named(c) for c in docs.columns if c != text]
    schema = docs.select(*rest, F.array(F.lit(0)).alias(out)).schema
    return docs.select(*rest, named(text)).mapInArrow(
        encode_batches(model or model_path(), text, {out: pa.list_(pa.int32())}, id_list), schema)


def decode_batches(model: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [sp.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, ids, pa.array(texts, pa.string()))

    return run


def decode_ids(docs: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` replaced by the text that it decodes to; null and empty: empty."""
    schema = docs.withColumn(ids, F.lit("")).schema
    return docs.mapInArrow(decode_batches(model or model_path(), ids), schema)


def op6(spark, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_digests(spark.read.parquet(f"{folder}/documents.parquet"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pipeline's last stage: (doc_id, n_tokens, ids_sha256, decoded_sha256) per row."""
    return encode_digests(docs)
