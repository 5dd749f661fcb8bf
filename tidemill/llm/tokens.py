"""Encoding a corpus with a byte-level BPE vocabulary, each distinct word once.

The texts are split into pre-tokens ("words") block by block. A block keeps one
code per word occurrence, in text order, and its list of distinct words; those
lists, not the occurrences, are shuffled. Sorted by word, every distinct word of
the corpus is encoded once; its ids go back to the blocks that hold it, and each
block puts the ids of its codes in place of them, which reassembles the texts.

No row of the shuffle by word is heavier than another: a word occurs at most
once per block, however often it stands in the corpus, and a word of very many
blocks is one group per BLOCKS_A_GROUP of them.

Decoding goes the same way: blocks keep a code per token and their list of
distinct tokens, which is joined with the token-byte table.

Results for special texts: null and empty texts get ``null_ids`` and
``empty_ids`` (both ``[]`` unless given); a text of blanks is a text like any
other. Strings that look like special tokens are ordinary text. Rows repeated in
the input are repeated in the result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import table_cut
from .textblocks import LETTER, SPACE, Block, class_table, decode, run_starts, slices, word_array

TOKENIZERS = os.environ.get("TIDEMILL_TOKENIZERS", "/opt/tokenizers")
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Blocks whose words are encoded together; a corpus of fewer encodes each distinct word once.
BLOCKS_A_GROUP = 1 << 16
#: The splitting pattern of these vocabularies (fixed value). ``pretoken_starts`` splits by the same rule.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_bytes(name: str, folder: str | None = None) -> bytes:
    """The rank file of a vocabulary. Read on the driver and sent with the plan: it is under 1 MB."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return f.read()


_encoders: dict[int, object] = {}


def encoder(data: bytes):
    """A tiktoken encoder, made once per Python worker."""
    key = hash(data)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pretoken_starts(block: Block) -> np.ndarray:
    """Character positions at which the pre-tokens of a block begin; they tile the block."""
    cp, n = block.cp, len(block.cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = class_table()[cp]
    start, doc = run_starts(block, cls)
    # the last blank before a visible character is a token of its own, or, being a space, leads that character's token
    last = np.zeros(n, bool)
    last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~doc[1:n]
    new_run = start.copy()
    start |= last
    start[np.flatnonzero(last & (cp == 0x20)) + 1] = False
    # contractions: an apostrophe that begins a token and is followed by one of a few letters
    at = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & new_run[1:] & (cls[1:] == LETTER) & ~doc[1:n])
    if len(at):
        c1 = cp[at + 1]
        one = np.isin(c1, [ord("s"), ord("t"), ord("m"), ord("d")])
        inside = at + 2 < n
        c2 = np.where(inside, cp[np.minimum(at + 2, n - 1)], 0)
        c2[inside & doc[np.minimum(at + 2, n)]] = 0
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        start[at[one | two] + 1] = False
        after = np.concatenate((at[one] + 2, at[two] + 3))
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _narrow(codes: np.ndarray, distinct: int) -> tuple[int, bytes]:
    """Codes in as few bytes as their number allows, compressed."""
    width = 1 if distinct <= 1 << 8 else 2 if distinct <= 1 << 16 else 4
    return width, pa.Codec("zstd").compress(codes.astype(f"<u{width}").tobytes(), asbytes=True)


def _wide(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, n * width, asbytes=True), f"<u{width}")


def _split(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts, limit):
            own = texts.slice(a, b - a)
            block = decode(own)
            starts = pretoken_starts(block)
            words = word_array(block, starts).dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            # frequent words get small codes, which compress better
            order = np.argsort(-np.bincount(codes, minlength=len(words.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            width, packed = _narrow(rank[codes], len(order))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([ids.slice(a, b - a)], pa.list_(id_type)),
                    pa.array([np.searchsorted(starts, block.doc_start).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([np.where(np.asarray(own.is_null()), 0, np.where(np.diff(block.doc_start) == 0, 1, 2)).astype(np.int8)], pa.list_(pa.int8())),
                    pa.array([width], pa.int32()),
                    pa.array([packed], pa.binary()),
                    pa.array([words.dictionary.take(pa.array(order))], pa.list_(pa.binary())),
                ],
                ["block", "row_ids", "tok_at", "state", "width", "codes", "words"],
            )
            seq += 1


def split_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of texts with codes of their words, written to the shared folder as two passes read them."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(docs[id_col].alias("row_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["row_id"].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("row_ids", T.ArrayType(kind)),
            T.StructField("tok_at", T.ArrayType(T.IntegerType())),
            T.StructField("state", T.ArrayType(T.ByteType())),
            T.StructField("width", T.IntegerType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
        ]
    )
    return table_cut(rows.mapInArrow(lambda it: _split(it, arrow, block_bytes), schema), "word-blocks")


def _encode_sorted(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    """(block, code, word) rows sorted by word -> (block, code, ids); each word is encoded once."""
    enc = encoder(ranks)
    last, last_ids = None, None
    for batch in batches:
        words = batch.column(2).dictionary_encode()
        ids = []
        for w in words.dictionary.to_pylist():
            if w != last:
                last, last_ids = w, enc.encode_ordinary(w.decode("utf-8"))
            ids.append(last_ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())).take(words.indices)], ["block", "code", "ids"])


def word_ids(blocks: DataFrame, ranks: bytes, group: int = BLOCKS_A_GROUP) -> DataFrame:
    """Ids of every distinct word of each block: one shuffle by word, in whose order each word is encoded once (once for every ``group`` blocks)."""
    # the number of blocks is a row count of the written table
    groups = -(-blocks.count() // group)
    pairs = blocks.select("block", F.posexplode("words").alias("code", "word"))
    salt = F.pmod(F.xxhash64("block"), F.lit(max(groups, 1)))
    by_word = pairs.repartition("word", salt).sortWithinPartitions("word")
    return by_word.mapInArrow(lambda it: _encode_sorted(it, ranks), "block long, code int, ids array<int>")


def _join_blocks(blocks: DataFrame, coded: DataFrame) -> DataFrame:
    found = coded.groupBy("block").agg(F.collect_list(F.struct("code", "ids")).alias("found"))
    return blocks.drop("words").join(found, "block", "left")


def _lists(row_codes: pa.Array, row_ids: pa.Array) -> pa.Array:
    """Ids by code, from (code, ids) in any order."""
    return row_ids.take(pa.array(np.argsort(row_codes.to_numpy(zero_copy_only=False), kind="stable")))


def _block_rows(batches: Iterator[pa.RecordBatch]):
    """Each block of a batch: its columns, codes and ids by code."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            tok_at = row["tok_at"][i].values.to_numpy(zero_copy_only=False)
            state = row["state"][i].values.to_numpy(zero_copy_only=False)
            codes = _wide(row["codes"][i].as_py(), row["width"][i].as_py(), int(tok_at[-1])) if tok_at[-1] else np.zeros(0, np.uint8)
            found = row["found"][i].values
            lists = _lists(found.field("code"), found.field("ids")) if found is not None and len(found) else pa.array([], pa.list_(pa.int32()))
            yield row["row_ids"][i].values, tok_at, state, codes, lists


def _assemble(batches: Iterator[pa.RecordBatch], null_ids: list[int], empty_ids: list[int]) -> Iterator[pa.RecordBatch]:
    for row_ids, tok_at, state, codes, lists in _block_rows(batches):
        taken = lists.take(pa.array(codes.astype(np.int64)))
        at = np.frombuffer(taken.offsets.buffers()[1], np.int32)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int32)
        out = pa.ListArray.from_arrays(pa.array(at[tok_at], pa.int32()), taken.flatten() if len(codes) else pa.array([], pa.int32()))
        for value, code in ((null_ids, 0), (empty_ids, 1)):
            if value and (state == code).any():
                out = pc.if_else(pa.array(state == code), pa.scalar(value, out.type), out)
        yield pa.RecordBatch.from_arrays([row_ids, out], ["row_id", "ids"])


def _count(batches: Iterator[pa.RecordBatch], null_n: int, empty_n: int) -> Iterator[pa.RecordBatch]:
    for row_ids, tok_at, state, codes, lists in _block_rows(batches):
        lengths = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(lengths[codes]))) if len(codes) else np.zeros(1, np.int64)
        n = np.diff(total[tok_at])
        n[state == 0], n[state == 1] = null_n, empty_n
        yield pa.RecordBatch.from_arrays([row_ids, pa.array(n, pa.int64())], ["row_id", "n_tokens"])


def _finish(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, folder: str | None, block_bytes: int, step, out: str) -> DataFrame:
    ranks = rank_bytes(vocabulary, folder)
    blocks = split_blocks(docs, id_col, text_col, block_bytes)
    rows = _join_blocks(blocks, word_ids(blocks, ranks)).select("row_ids", "tok_at", "state", "width", "codes", "found")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row_id", kind), T.StructField(out, T.LongType() if out == "n_tokens" else T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(step, schema).withColumnRenamed("row_id", id_col)


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None,
    null_ids: list[int] | None = None, empty_ids: list[int] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id_col, ids) of every row. Other columns of docs play no part, whatever their names."""
    a, b = list(null_ids or []), list(empty_ids or [])
    return _finish(docs, id_col, text_col, vocabulary, folder, block_bytes, lambda it: _assemble(it, a, b), "ids")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_tokens) of every row: the lengths of encode_corpus's lists, without building them."""
    return _finish(docs, id_col, text_col, vocabulary, folder, block_bytes, lambda it: _count(it, 0, 0), "n_tokens")


def token_table(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(token_id, token_bytes): as many rows as the vocabulary has entries."""
    rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, rank_bytes(vocabulary, folder).splitlines())]
    return spark.createDataFrame(rows, "token_id int, token_bytes binary")


def _split_ids(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(row_id, ids) rows -> blocks of at most about ``limit`` ids with a code per id and their distinct ids."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        lengths = np.asarray(pc.list_value_length(batch.column(1)).fill_null(0)).astype(np.int64)
        ends, a = np.cumsum(lengths), 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            lists = batch.column(1).slice(a, b - a)
            coded = lists.flatten().dictionary_encode()
            width, packed = _narrow(coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))
            at = np.concatenate(([0], np.cumsum(lengths[a:b])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()), pa.array([batch.column(0).slice(a, b - a)], pa.list_(batch.column(0).type)), pa.array([at], pa.list_(pa.int64())),
                    pa.array([np.asarray(lists.is_valid())], pa.list_(pa.bool_())), pa.array([width], pa.int32()), pa.array([packed], pa.binary()), pa.array([coded.dictionary], pa.list_(pa.int32())),
                ],
                ["block", "row_ids", "tok_at", "present", "width", "codes", "tokens"],
            )
            seq, a = seq + 1, b


def _join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with (code, bytes) of their distinct tokens -> (row_id, text)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            tok_at, present = row["tok_at"].values.to_numpy(zero_copy_only=False), row["present"].as_py()
            texts: list[str | None] = ["" if ok else None for ok in present]
            if tok_at[-1]:
                found = row["found"].values
                if (found.field("bytes").null_count) or len(found) == 0:
                    raise ValueError("an id isn't in the vocabulary")
                by_code = found.field("bytes").take(pa.array(np.argsort(found.field("code").to_numpy(zero_copy_only=False), kind="stable"))).cast(pa.large_binary())
                parts = by_code.take(pa.array(_wide(row["codes"].as_py(), row["width"].as_py(), int(tok_at[-1])).astype(np.int64)))
                # what take() made is one buffer holding the tokens' bytes in order
                ends, joined = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1], bytes(parts.buffers()[2] or b"")
                texts = [joined[ends[a] : ends[b]].decode("utf-8", "replace") if ok else None for a, b, ok in zip(tok_at[:-1], tok_at[1:], present)]
            yield pa.RecordBatch.from_arrays([row["row_ids"].values, pa.array(texts, pa.string())], ["row_id", "text"])


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None, null_ids: list[int] | None = None, block_ids: int = 1 << 21) -> DataFrame:
    """(id_col, text): every block's distinct ids are joined with the token-byte table, and put in place of the codes. Null lists, and lists equal to null_ids if given, give null; an id outside the vocabulary is an error."""
    rows = encoded.select(encoded[id_col].alias("row_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    if null_ids:
        rows = rows.withColumn("ids", F.when(F.col("ids") != F.array(*[F.lit(int(i)) for i in null_ids]), F.col("ids")))
    kind = rows.schema["row_id"].dataType
    fields = [("block", T.LongType()), ("row_ids", T.ArrayType(kind)), ("tok_at", T.ArrayType(T.LongType())), ("present", T.ArrayType(T.BooleanType())), ("width", T.IntegerType()), ("codes", T.BinaryType()), ("tokens", T.ArrayType(T.IntegerType()))]
    blocks = table_cut(rows.mapInArrow(lambda it: _split_ids(it, block_ids), T.StructType([T.StructField(*f) for f in fields])), "id-blocks")
    pairs = blocks.select("block", F.posexplode("tokens").alias("code", "token_id"))
    # the table has as many rows as the vocabulary
    named = pairs.join(F.broadcast(token_table(rows.sparkSession, vocabulary, folder)), "token_id", "left")
    found = named.groupBy("block").agg(F.collect_list(F.struct("code", F.col("token_bytes").alias("bytes"))).alias("found"))
    whole = blocks.drop("tokens").join(found, "block", "left").select("row_ids", "tok_at", "present", "width", "codes", "found")
    schema = T.StructType([T.StructField("row_id", kind), T.StructField("text", T.StringType())])
    return whole.mapInArrow(_join_bytes, schema).withColumnRenamed("row_id", id_col)
