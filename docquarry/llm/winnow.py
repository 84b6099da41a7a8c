"""Which windows may repeat: winnowed fingerprints exchanged between blocks and buckets.

Documents are dealt into blocks by a hash of their id.  Each window of k tokens
(words or bytes) has an anchor, the least hash of its g-token grams; equal windows
have equal anchors, and neighbouring windows mostly share one, so a block's distinct
anchors are several times fewer than its windows.  They go to hash buckets as packed
arrays, one row for each block and bucket; a bucket answers each block with the
anchors that other blocks have too.  Only windows with such an anchor go further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import textblocks as tb

KEY_BITS = 40
#: Bytes of text that a task packs at once.
PACK_BYTES = 8 << 20


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text; rows without an id or text are left out."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null and text is not null and text <> ''")


def count_blocks(rows: DataFrame, block_bytes: int) -> int:
    """Blocks of about block_bytes of text each; only their number comes to the driver."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def block_of(col: str, n: int):
    return F.expr(f"cast(pmod(xxhash64({col}), {n}) as int)")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """block, payload: rows (id, text) dealt into n blocks and packed before they are shuffled, by zstd as Arrow streams."""
    return rows.select("id", "text", block_of("id", n).alias("block")).mapInArrow(_pack, "block int, payload binary")


def _pack(batches):
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for table in tb.iter_blocks(batches, "text", PACK_BYTES):
        block = np.asarray(table["block"])
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        table = table.select(["id", "text"]).take(pa.array(order)).combine_chunks()
        payloads = []
        for x, y in zip(edge, np.r_[edge[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.slice(x, y - x))
            payloads.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(block[order][edge], pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])


_EMPTY = pa.table([pa.array([], pa.int64()), pa.array([], pa.string())], names=["id", "text"])


def sorted_block(packed: pa.Table) -> pa.Table:
    """The rows of a block in the order of (id, text); with ``past``, if the packed rows tell it."""
    parts = [_EMPTY]
    for row in packed.to_pylist():
        got = pa.ipc.open_stream(row["payload"]).read_all()
        parts.append(pa.table([got["id"].cast(pa.int64()), got["text"].cast(pa.string())], names=["id", "text"]))
        if "past" in row:
            parts[-1] = parts[-1].append_column("past", pa.array([row["past"]] * len(got), pa.bool_()))
    if "past" in packed.column_names:
        parts[0] = _EMPTY.append_column("past", pa.array([], pa.bool_()))
    return pa.concat_tables(parts).sort_by([("id", "ascending"), ("text", "ascending")])


def anchors(values: np.ndarray, doc: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window at each place, whether the window lies in one document)."""
    least, inside = least_grams(values, doc, k, g)
    return tb.mix(least), inside


def least_grams(values: np.ndarray, doc: np.ndarray, k: int, g: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Like anchors, but as the least hashes themselves, which are not spread evenly."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, tb.U), np.zeros(0, bool)
    return tb.shifted(tb.window_hash(values, g, sums), k - g + 1), doc[:n] == doc[k - 1 :]


def occurrences(anchor: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where a new run of windows with one anchor begins."""
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    return np.flatnonzero(first)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> tb.U(48)) * tb.U(n)) >> tb.U(16)).astype(np.int64)


def low(keys: np.ndarray) -> np.ndarray:
    return keys & tb.U((1 << KEY_BITS) - 1)


def by_bucket(keys: np.ndarray, n: int):
    """(bucket, places in keys) of distinct keys, ascending in their low bits within a bucket."""
    bucket = bucket_of(keys, n)
    order = np.argsort((bucket.astype(tb.U) << tb.U(KEY_BITS)) | low(keys))
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if y > x:
            yield b, order[x:y]


def join_shared(rows: list[tuple[int, int, bytes]]) -> dict[int, np.ndarray]:
    """Shared anchors (bucket, low bits) of a block, by bucket."""
    out: dict[int, list[np.ndarray]] = {}
    for bucket, _, raw in rows:
        out.setdefault(bucket, []).append(tb.unpack(raw))
    return {b: np.unique(np.concatenate(x)) for b, x in out.items()}


def among(keys: np.ndarray, shared: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Which keys are shared."""
    table = np.sort(np.concatenate([(np.full(len(x), b, tb.U) << tb.U(KEY_BITS)) | x for b, x in shared.items()])) if shared else np.zeros(0, tb.U)
    if len(table) == 0:
        return np.zeros(len(keys), bool)
    mine = (bucket_of(keys, n).astype(tb.U) << tb.U(KEY_BITS)) | low(keys)
    at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
    return table[at] == mine
