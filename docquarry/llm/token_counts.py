"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, where no token, normaliser rule or special string
can reach across.  Where white space only separates words these are white space, and
between an ASCII letter or digit and one closing punctuation mark; the distinct
pieces of a block are encoded once.  Elsewhere long texts are cut at spaces between
ASCII letters or digits.  Pieces are encoded in batches of even byte size; a
document's count is the sum over its pieces.  There is no shuffle: each task streams its own split, so the work is
balanced by the bytes of the splits, and a long text is many short pieces.

Defined cases: a null text is empty (0 bytes, 0 tokens); null ids and repeated
rows are counted like any other row; an empty table gives an empty result; of
further columns only the named ones are read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textblocks as tb

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Bytes of pieces handed to the tokenizer at once.
BATCH_BYTES = 256 << 10
#: Bytes from which a text is cut where white space belongs to tokens.
PIECE_BYTES = 64 << 10
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20

_CLOSING = tb._lut(*b".,;:!?")
_ALNUM = tb._lut(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))
_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """(function from texts to token counts, words counted before, where texts may be cut), loaded once for each worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], {}, _model_cuts(model))
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            os.environ["RAYON_NUM_THREADS"] = "1"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = (lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)], {}, _tokenizer_cuts(tok))
    return _loaded[path]


def _model_cuts(model) -> str | None:
    """"without" if a space between letters can be left out there: no piece has a word's end and what follows it."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    apart = all("\u2581" not in piece.lstrip("\u2581") for piece in pieces)
    return "without" if apart and model.encode("x1 y") == model.encode("x1") + model.encode("y") else None


def _tokenizer_cuts(tok) -> str | None:
    """"words" if white space only separates words; "before" if a space between letters goes with what follows it."""
    of = lambda text: [x for x, _ in tok.pre_tokenizer.pre_tokenize_str(text)] if tok.pre_tokenizer else [text]
    if of("a b\tc\n d") == of("a") + of("b") + of("c") + of("d"):
        return "words"
    return "before" if tok.normalizer is None and of("x1 y z2 w") == of("x1") + of(" y") + of(" z2") + of(" w") else None


def _in_batches(encode, pieces: list[bytes]) -> list[int]:
    """Counts of the pieces, encoded in batches of about equal bytes."""
    out: list[int] = []
    at = size = 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= BATCH_BYTES:
            out += encode([x.decode() for x in pieces[at : i + 1]])
            at, size = i + 1, 0
    return out + (encode([x.decode() for x in pieces[at:]]) if at < len(pieces) else [])


def _whole_counts(encode, data: np.ndarray, off: np.ndarray, cuts: str | None) -> np.ndarray:
    """Tokens of each document, long ones in pieces of ``PIECE_BYTES`` or more that are cut at spaces between ASCII letters or digits."""
    raw, pieces, owner = data.tobytes(), [], []
    space = np.zeros(0, np.int64)
    if cuts and len(off) > 1 and int(np.diff(off).max()) > PIECE_BYTES:
        space = np.flatnonzero((data[1:-1] == 0x20) & _ALNUM[data[:-2]] & _ALNUM[data[2:]]) + 1
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        while b - a > PIECE_BYTES:
            at = int(np.searchsorted(space, a + PIECE_BYTES))
            if at == len(space) or space[at] >= b:
                break
            pieces.append(raw[a : space[at]])
            owner.append(i)
            a = int(space[at]) + (cuts == "without")
        pieces.append(raw[a:b])
        owner.append(i)
    counts = _in_batches(encode, pieces)
    return np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(off) - 1).astype(np.int64)


def block_counts(path: str, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens of each document of a block."""
    encode, known, cuts = _encoder(path)
    if cuts != "words":
        return _whole_counts(encode, data, off, cuts)
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    if len(starts) == 0:
        return np.zeros(len(off) - 1, np.int64)
    tail = (ends - starts > 1) & _CLOSING[data[ends - 1]] & _ALNUM[data[np.maximum(ends - 2, 0)]]
    starts = np.concatenate([starts, ends[tail] - 1])
    doc = np.concatenate([doc, doc[tail]])
    ends = np.concatenate([ends - tail, ends[tail]])
    _, first, which = np.unique(tb.span_hash(tb.prefix_sums(tb.BYTE_VALUES[data]), starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if len(known) > REMEMBERED:
        known.clear()
    new = [p for p in pieces if p not in known]
    known.update(zip(new, _in_batches(encode, new)))
    counts = np.array([known[p] for p in pieces], dtype=np.int64)
    return np.bincount(doc, weights=counts[which], minlength=len(off) - 1).astype(np.int64)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row."""

    def run(batches):
        for block in tb.iter_blocks(batches, "text", BLOCK_BYTES):
            data, off = tb.text_buffers(block["text"])
            n = block_counts(path, data, off)
            yield pa.record_batch([block["id"].combine_chunks(), pa.array(np.diff(off)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the word BPE with 49k entries."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
