r"""Substring dedup over a log-structured fingerprint index.

The index holds sorted immutable runs: for each hash bucket the anchors (winnowed
fingerprints, see :mod:`winnow`) of the distinct 20-word windows of historical
documents, with the documents that had them first: a window that an earlier place
has too is found through that place.  A new batch is processed in four steps.

1. Its anchors, sorted by bucket, are merge-joined with the runs and with each
   other.  Out come the anchors that some other block of the batch, or history,
   has too, and the historical documents that have them.
2. Those historical documents are read again from the corpus.  Windows with a
   shared anchor, of the batch and of history, are fingerprinted anew over all
   their 20 words (96 bits): this verifies the hit, as a shared anchor alone only
   shows that half a window is equal.
3. Buckets of these fingerprints find the first holder of each window; a block
   removes the words of every window that history, an earlier document or an
   earlier place has.
4. The anchors of the batch's windows that nothing earlier has become a new run; when
   more than ``FANOUT`` runs of a level exist they are merged into one of the next
   level, which later batches read, and the old ones are deleted.

A manifest beside the runs names those that count, and is replaced as a whole after
each change, before anything is deleted: a job that stops leaves the index as it was
before or after the change, and another one opens it with its path and the historical
documents.

Batches must come in the order in which documents take precedence; within a batch
the smaller id, then the earlier start, comes first.

Defined cases: a null or empty text has no words; rows with a null id are counted
but neither change nor are matched; rows that repeat an id are taken in the order
of their texts; fewer than 20 words have no window; an empty batch adds an empty
run; further columns are not read.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints, winnow
from docquarry.llm import textblocks as tb
from docquarry.llm.textblocks import U

WINDOW = 20
GRAM = 10
BLOCK_BYTES = 4 << 20
#: Runs of one level before they are compacted.
FANOUT = 4
#: Batches of the query: all but the last write a run, so that the last one reads compacted runs.
BATCHES = FANOUT + 2
#: Historical documents to read again that are broadcast; more are joined by a shuffle.
BROADCAST_HOLDERS = 100_000
_RUN = "bucket int, payload binary"
_ROWS = "bucket int, block int, payload binary"
#: The order number of all historical documents, and the block that stands for them.
_PAST, _NOBODY = np.iinfo(np.int64).min, -1


def _words(table: pa.Table):
    """(data, off, starts, ends, document index, word hashes) of a sorted block."""
    data, off = tb.text_buffers(table["text"])
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    return data, off, starts, ends, doc, tb.span_hash(tb.prefix_sums(tb.BYTE_VALUES[data]), starts, ends)


def _pack_holders(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending keys (repeats allowed) with an id each."""
    used, place = np.unique(ids, return_inverse=True)
    kind = "<u2" if len(used) < 1 << 16 else "<u4"
    packed = tb.pack(keys)
    return b"".join([len(used).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, used.astype("<i8").tobytes(), place.astype(kind).tobytes()])


def _unpack_holders(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    keys = tb.unpack(raw[8 : 8 + size])
    used = np.frombuffer(raw, "<i8", n, 8 + size)
    place = np.frombuffer(raw, "<u2" if n < 1 << 16 else "<u4", len(keys), 8 + size + 8 * n)
    return keys, used[place]


def _anchors_of_block(n: int):
    """Rows (bucket, block, payload) of a block's distinct anchors."""

    def run(key, table):
        block = key[0].as_py()
        *_, doc, values = _words(winnow.sorted_block(table))
        anchor, inside = winnow.anchors(values, doc, WINDOW, GRAM)
        a = np.unique(anchor[winnow.occurrences(anchor, inside)])
        return _rows([(b, block, tb.pack(winnow.low(a[p]))) for b, p in winnow.by_bucket(a, n)])

    return run


def _run_of_block(n: int):
    """Rows (bucket, block, payload) of the distinct (anchor, document) pairs of a block's windows that nothing earlier has."""

    def run(key, docs, later):
        block = key[0].as_py()
        docs = winnow.sorted_block(docs)
        ids = np.asarray(docs["id"].combine_chunks())
        *_, doc, values = _words(docs)
        at, gone = _repeats(values, doc, later)
        at = at[~gone]
        anchor, _ = winnow.anchors(values, doc, WINDOW, GRAM)
        a, d = _unrepeated(anchor[at], ids[doc[at]])  # neighbours mostly share an anchor
        order = np.lexsort((d, a))
        a, d = _unrepeated(a[order], d[order])
        return _rows([(b, block, _pack_holders(winnow.low(a[p]), d[p])) for b, p in winnow.by_bucket(a, n)])

    return run


def _unrepeated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a and b that differ from the pair before."""
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "block", "payload"])


def _shared_anchors(key, new, old):
    """A bucket's answers: to each block of the batch its shared anchors (holder null), and the historical holders."""
    bucket = key[0].as_py()
    got = [(r["block"], tb.unpack(r["payload"])) for r in new.to_pylist()]
    if not got:
        return _answers(bucket, [], [], [])
    many, count = np.unique(np.concatenate([k for _, k in got]), return_counts=True)
    shared = many[count > 1]
    holders, found = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    if old.num_rows:
        # merge-join: the runs are sorted, so each is searched once with the sorted keys
        hit = np.zeros(len(many), bool)
        for payload in old["payload"]:
            k, ids = _unpack_holders(payload.as_py())
            x, y = np.searchsorted(k, many, "left"), np.searchsorted(k, many, "right")
            hit |= y > x
            member = np.zeros(len(k) + 1, np.int64)
            np.add.at(member, x[y > x], 1)
            np.add.at(member, y[y > x], -1)
            mask = np.cumsum(member[:-1]) > 0
            found.append(k[mask])
            holders.append(ids[mask])
        shared = np.union1d(shared, many[hit])
    mine = [(b, k[np.isin(k, shared)]) for b, k in got]
    return _answers(bucket, [(b, k) for b, k in mine if len(k)], np.concatenate(holders), np.concatenate(found))


def _answers(bucket: int, mine, holders, found) -> pa.Table:
    """(bucket, block, payload, holder): to blocks of the batch, and of each historical holder its shared anchors."""
    order = np.lexsort((found, holders))
    found, holders = _unrepeated(np.asarray(found, U)[order], np.asarray(holders, np.int64)[order])
    cuts = np.r_[np.flatnonzero(np.r_[True, holders[1:] != holders[:-1]]), len(holders)] if len(holders) else np.zeros(1, np.int64)
    payload = [tb.pack(k) for _, k in mine] + [tb.pack(found[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
    block = [b for b, _ in mine] + [None] * (len(cuts) - 1)
    holder = [None] * len(mine) + holders[cuts[:-1]].tolist()
    return pa.table([pa.array([bucket] * len(block), pa.int32()), pa.array(block, pa.int32()), pa.array(payload, pa.binary()), pa.array(holder, pa.int64())], names=["bucket", "block", "payload", "holder"])


def _fingerprints(n: int):
    """Rows (bucket, block, payload) of the windows with a shared anchor: key, check, least holder.

    Documents of history precede those of the batch, and go to rows of their own that get no answer."""

    def run(key, docs, shared):
        block = key[0].as_py()
        docs = winnow.sorted_block(docs)
        if docs.num_rows == 0 or shared.num_rows == 0:
            return _rows([])
        ids = np.where(np.asarray(docs["past"].combine_chunks().cast(pa.uint8())) > 0, _PAST, np.asarray(docs["id"].combine_chunks()))
        *_, doc, values = _words(docs)
        anchor, inside = winnow.anchors(values, doc, WINDOW, GRAM)
        table = winnow.join_shared([(r["bucket"], 0, r["payload"]) for r in shared.to_pylist()])
        at = np.flatnonzero(inside)
        at = at[winnow.among(anchor[at], table, n)]
        h = tb.window_hash(values, WINDOW)[at]
        check = (tb.window_hash(tb.mix(values ^ U(0xD1B54A32D192ED03)), WINDOW)[at] >> U(32)).astype(np.uint32)
        d = ids[doc[at]]
        past = d == _PAST
        rows = [(b, _NOBODY, raw) for b, raw in _dealt_prints(h[past], check[past], d[past], n)]
        rows += [(b, block, raw) for b, raw in _dealt_prints(h[~past], check[~past], d[~past], n)]
        return _rows(rows)

    return run


def _dealt_prints(h, check, d, n: int):
    """(bucket, payload) of distinct fingerprints, each with its least holder."""
    order = np.lexsort((d, check, h))
    h, check, d = h[order], check[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])] if len(h) else np.zeros(0, bool)
    h, check, d = h[new], check[new], d[new]
    cuts = np.searchsorted(winnow.bucket_of(h, n), np.arange(n + 1))
    for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if y > x:
            yield b, int(y - x).to_bytes(4, "little") + check[x:y].astype("<u4").tobytes() + _pack_holders(h[x:y], d[x:y])


def _later_windows(key, table):
    """To each block the windows whose first holder is not its own."""
    rows = table.to_pylist()
    if not rows:
        return _rows([])
    parts = []
    for r in rows:
        raw = r["payload"]
        n = int.from_bytes(raw[:4], "little")
        h, d = _unpack_holders(raw[4 + 4 * n :])
        parts.append((h, np.frombuffer(raw, "<u4", n, 4), d, np.full(n, r["block"])))
    h, check, d, block = map(np.concatenate, zip(*parts))
    order = np.lexsort((d, check, h))
    h, check, d, block = h[order], check[order], d[order], block[order]
    edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    least = np.repeat(d[edge], np.diff(np.r_[edge, len(h)]))
    later = (d > least) & (block != _NOBODY)
    out = []
    for b in np.unique(block[later]):
        out.append((key[0].as_py(), int(b), tb.pack(np.unique(h[later & (block == b)]))))
    return _rows(out)


def _repeats(values, doc, later) -> tuple[np.ndarray, np.ndarray]:
    """(places of a block's windows, which of them start earlier too)."""
    h = tb.window_hash(values, WINDOW)
    at = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :]) if len(h) else np.zeros(0, np.int64)
    gone = np.ones(len(at), bool)
    if len(at):
        order = np.argsort(h[at])
        h = h[at][order]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        first = np.minimum.reduceat(order, edge)
        if later.num_rows:
            known = np.sort(np.concatenate([tb.unpack(x.as_py()) for x in later["payload"]]))
            first = first[known[np.minimum(np.searchsorted(known, h[edge]), len(known) - 1)] != h[edge]]
        gone[first] = False
    return at, gone


def _result(key, docs, later):
    """Per row of a block: n_words, n_removed and the kept words."""
    docs = winnow.sorted_block(docs)
    data, off, starts, ends, doc, values = _words(docs)
    n = docs.num_rows
    at, gone = _repeats(values, doc, later)
    removed = tb.cover(at[gone], WINDOW, len(values))
    keep = np.flatnonzero(~removed)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]
    cuts = np.searchsorted(doc[keep], np.arange(n + 1))
    kept = [b" ".join(words[x:y]).decode() for x, y in zip(cuts[:-1], cuts[1:])]
    counts = np.bincount(doc, minlength=n)
    return pa.table([docs["id"], pa.array(counts.astype(np.int64)), pa.array((counts - np.diff(cuts)).astype(np.int64)), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


class FingerprintIndex:
    """Runs of historical fingerprints in a shared folder, and the documents they came from.

    With a path that holds an index, this goes on from it: history is then the table of
    the documents of all its batches.  The number of buckets is that of the first batch."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", fanout: int = FANOUT, block_bytes: int = BLOCK_BYTES) -> None:
        checkpoints.ensure_folder(spark)
        self.spark, self.fanout, self.block_bytes = spark, fanout, block_bytes
        self.path = path or f"{spark.sparkContext.getCheckpointDir()}/fingerprints-{uuid.uuid4()}"
        self.runs: list[tuple[int, str]] = []  # (level, folder), oldest first
        self.history: DataFrame | None = None
        self.past_blocks = 0  # so many hold all of history
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, known = _read_manifest(spark, self.path)
        if known is not None:
            if history is None:
                raise ValueError(f"{self.path} holds an index: history is needed")
            self.buckets, self.runs = known["buckets"], [(level, f"{self.path}/{name}") for level, name in known["runs"]]
            self.history = winnow.rows_of(history, id_col, text_col)
            self.past_blocks = winnow.count_blocks(self.history, block_bytes)

    def _record(self) -> None:
        self.version = _write_manifest(self.spark, self.path, self.version + 1, {"buckets": self.buckets, "runs": [(level, folder.rsplit("/", 1)[1]) for level, folder in self.runs]})

    def _stored(self) -> DataFrame:
        out = self.spark.createDataFrame([], _RUN)
        for _, folder in self.runs:
            out = out.unionByName(self.spark.read.schema(_RUN).parquet(folder))
        return out

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", last: bool = False) -> DataFrame:
        """id, n_words, n_removed, kept of the batch's rows with an id and a text; the batch becomes history.

        ``last`` says that no batch follows, so that no run is written."""
        n = self.buckets
        rows = winnow.rows_of(docs, id_col, text_col)
        n_blocks = winnow.count_blocks(rows, self.block_bytes)
        batch = checkpoints.cut(winnow.dealt(rows, n_blocks))  # packed once for all that follows
        fresh = batch.groupBy("block").applyInArrow(_anchors_of_block(n), _ROWS)
        answers = fresh.groupBy("bucket").cogroup(self._stored().groupBy("bucket")).applyInArrow(_shared_anchors, f"{_ROWS}, holder long")
        compared = batch.withColumn("past", F.lit(False))
        if self.runs:
            answers = checkpoints.cut(answers)
            mine = answers.where("holder is null").select("bucket", "block", "payload")
            theirs = answers.where("holder is not null")
            holders = theirs.select(F.col("holder").alias("id")).distinct()
            past = self.history.join(F.broadcast(holders) if holders.count() <= BROADCAST_HOLDERS else holders, "id", "left_semi")
            # history lies in blocks of its own, so that no block grows with the number of batches
            beyond = lambda block: (block + n_blocks).alias("block")
            shared = mine.unionByName(theirs.select("bucket", beyond(winnow.block_of("holder", self.past_blocks)), "payload"))
            compared = compared.unionByName(winnow.dealt(past, self.past_blocks).select(beyond(F.col("block")), "payload", F.lit(True).alias("past")))
        else:
            shared = answers.select("bucket", "block", "payload")
        prints = compared.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_fingerprints(n), _ROWS)
        later = prints.groupBy("bucket").applyInArrow(_later_windows, _ROWS)
        if not last:
            later = checkpoints.cut(later)
            folder = f"{self.path}/run-{uuid.uuid4()}"
            batch.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(_run_of_block(n), _ROWS).select("bucket", "payload").write.parquet(folder)
            self.runs.append((0, folder))
            self._record()
            self.history = rows if self.history is None else self.history.unionByName(rows)
            self.past_blocks += n_blocks
        return batch.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(_result, "id long, n_words long, n_removed long, kept string")

    def compact(self) -> None:
        """Merge the runs of any level that has more than ``fanout`` of them; deletes the merged ones."""
        for level in range(max((x for x, _ in self.runs), default=-1) + 1):
            full = [f for x, f in self.runs if x == level]
            if len(full) <= self.fanout:
                continue
            merged = f"{self.path}/run-{uuid.uuid4()}"
            rows = self.spark.read.schema(_RUN).parquet(*full)
            rows.groupBy("bucket").applyInArrow(_merge_run, _RUN).write.parquet(merged)
            self.runs = [r for r in self.runs if r[1] not in full] + [(level + 1, merged)]
            self._record()
            for folder in full:
                _delete(self.spark, folder)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        self.runs = []


def _merge_run(key, table):
    keys, ids = map(np.concatenate, zip(*(_unpack_holders(p.as_py()) for p in table["payload"])))
    order = np.lexsort((ids, keys))
    keys, ids = _unrepeated(keys[order], ids[order])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([_pack_holders(keys, ids)], pa.binary())], names=["bucket", "payload"])


def _folder(spark: SparkSession, name: str):
    """(path, its file system)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, name: str) -> None:
    path, files = _folder(spark, name)
    files.delete(path, True)


def _read_manifest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Number and content of the last manifest; 0 and None without one."""
    path, files = _folder(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    last = max((int(n.split("-")[1]) for n in names if n.startswith("manifest-")), default=0)
    if not last:
        return 0, None
    (row,) = spark.read.text(f"{folder}/manifest-{last}", wholetext=True).collect()
    return last, json.loads(row.value)


def _write_manifest(spark: SparkSession, folder: str, version: int, content: dict) -> int:
    """Written under another name and then moved, so that it is there as a whole or not at all; the one before goes."""
    path, files = _folder(spark, f"{folder}/manifest-{version}")
    draft, _ = _folder(spark, f"{folder}/draft-{version}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if not files.rename(draft, path):
        raise OSError(f"cannot write {path}")
    _delete(spark, f"{folder}/manifest-{version - 1}")
    return version


def dedup_substrings(docs: DataFrame, *, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept and its digest for all rows, taken in ``batches`` ranges of ids, one after another."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark)
    cuts = docs.agg(F.percentile_approx(docs[id_col].cast("long"), [i / batches for i in range(1, batches)] or [0.5], 10_000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    ident = docs[id_col].cast("long")
    out = None
    for after, upto in zip(bounds[:-1], bounds[1:]):
        part = docs
        if after is not None:
            part = part.where(ident > after)
        if upto is not None:
            part = part.where(ident <= upto)
        got = index.add(part, id_col=id_col, text_col=text_col, last=upto is None)
        got = checkpoints.cut(got.select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
        if upto is not None:
            index.compact()
            index.history = winnow.rows_of(docs.where(ident <= upto), id_col, text_col)  # in one scan
        out = got if out is None else out.unionByName(got)
    index.drop()
    words = F.size(F.filter(F.split(F.coalesce(docs[text_col].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rest = docs.where(ident.isNull() | docs[text_col].isNull() | (docs[text_col].cast("string") == ""))
    plain = F.array_join(F.filter(F.split(F.coalesce(docs[text_col].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    rest = rest.select(ident.alias("id"), words.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(plain, 256).alias("kept_sha256"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows of all documents, in as many batches as have the index compacted and read again."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g),
k AS (SELECT w.doc_id, w.w, list(c.j) FILTER (c.j IS NOT NULL) AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM k
"""
