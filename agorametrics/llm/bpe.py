"""Byte-level BPE with the tiktoken library and a local rank file.

A text is cut at safe boundaries: before white space that follows something else. No alternative of
the split pattern holds white space after another character, so a match always ends there, and the
look-ahead of the pattern only looks inside one run of white space. Cut texts therefore give the ids
of whole ones, however long they are. A chunk that occurs often in a batch is encoded once.

Null and empty texts have no ids; an empty table gives no rows. Repeated rows each keep their row.
Other columns stay, one with the name of a new column (``out``) is replaced.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.llm.common import PIECE, lists, packed, pieces, put, ragged, raw

_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x09:0x0E] = _BLANK[0x20] = True

_encoders: dict = {}  # of this process: reading the ranks costs more than a batch


def encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and before a blank behind a character that is surely none.

    Behind a character outside ASCII only lead bytes that no white space has count as sure.
    """
    at = np.flatnonzero(_BLANK[data])
    at = at[at > 0]
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    sure = (one >= 0x21) & (one <= 0x7E)
    sure |= (one >= 0x80) & (two >= 0xC3) & (two <= 0xDF)
    sure |= (one >= 0x80) & (two >= 0x80) & (two <= 0xBF) & (three >= 0xE4) & (three <= 0xEF)
    first = np.zeros(data.size, dtype=bool)
    first[at[sure]] = first[offsets[:-1][offsets[:-1] < data.size]] = True
    return np.flatnonzero(first)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of the whole ``text`` as array<int>, without special tokens.

    ``decoded`` names a column for the bytes that the ids stand for, made in the same pass.
    """
    new = [T.StructField(out, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    kind = T.StructType([f for f in docs.schema if f.name not in (out, decoded)] + new)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, own = to_arrow_schema(kind), encoder(path, pattern)
        schema = schema.set(schema.get_field_index(out), pa.field(out, pa.list_(pa.int32())))
        for batch in pieces(batches, text, 2 * PIECE):
            data, offsets = raw(batch.column(batch.schema.get_field_index(text)))
            cuts = safe_cuts(data, offsets)
            ends = np.append(cuts[1:], data.size)
            chunks = packed(data, slice(None), cuts, ends, pa.string()).dictionary_encode()
            found = [own.encode_ordinary(x) for x in chunks.dictionary.to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            codes = chunks.indices.to_numpy()
            ids = flat[ragged((np.cumsum(size) - size)[codes], size[codes])]
            at = np.concatenate([[0], np.cumsum(size[codes])])[np.searchsorted(cuts, offsets)]
            columns = {out: lists(pa.array(ids, pa.int32()), at)}
            if decoded:
                texts = [own.decode_bytes(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns[decoded] = pa.array(texts, schema.field(decoded).type)
            yield put(batch, schema, **columns)

    return docs.mapInArrow(run, kind)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for; null ids give no bytes."""
    kind = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, own = to_arrow_schema(kind), encoder(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [own.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in column]
            yield put(batch, schema, **{out: pa.array(texts, schema.field(out).type)})

    return docs.mapInArrow(run, kind)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids, digest of the bytes they decode to."""
    both = encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
