"""SentencePiece encoding and decoding of document tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import piece_model
from .common import CHUNK_BYTES, batch, slices


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, ids (array of int).

    Defined cases: a null or empty text has no ids; texts of any length are whole; a null doc_id stays null; repeated
    rows are encoded each; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = piece_model.model(model_path)
        for rows in batches:
            texts = [x or "" for x in rows.column("text").to_pylist()]
            for a, b in slices(map(len, texts), CHUNK_BYTES):
                yield batch({"doc_id": rows.column("doc_id").slice(a, b - a), "ids": [np.frombuffer(x, "<i4") for x in model.encode(texts[a:b])]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, ids) -> doc_id, text.  Null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = piece_model.model(model_path)
        for rows in batches:
            yield batch({"doc_id": rows.column("doc_id"), "text": [model.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in rows.column("ids")]}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit), text_sha256 (of the decoded text) and same (whether it is the text again).

    One pass encodes and decodes: ids do not leave the worker.
    """
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("text_sha256", pa.string()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [x or "" for x in rows.column("text").to_pylist()]
            for a, b in slices(map(len, texts), CHUNK_BYTES):
                out: dict[str, list] = {name: [] for name in schema.names}
                for doc, text, (ids, back) in zip(rows.column("doc_id").slice(a, b - a).to_pylist(), texts[a:b], piece_model.encode_all(model_path, texts[a:b]), strict=True):
                    for name, x in zip(schema.names, (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text), strict=True):
                        out[name].append(x)
                yield batch(out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, same boolean")
