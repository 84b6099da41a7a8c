"""Substring dedup by suffix arrays: bytes covered by a 50-byte string that an earlier document has too.

1. Blocks of documents send their distinct anchors (winnowed 25-byte grams of their
   50-byte windows, see :mod:`winnow`) to buckets, which answer with the anchors
   that occur more than once.  Windows without such an anchor cannot repeat.
2. The other windows go, as maximal segments of windows with one anchor, to the
   shard of their anchor, so equal strings meet in one shard.  Segments with equal
   bytes travel once for each block, under the least document that has them.
3. A shard cuts its segments into pieces of bounded size.  Each piece gets a suffix
   array by Larsson-Sadakane refinement (order by 8 bytes, then doubling among what
   is not yet told apart) and its common prefixes by Kasai's method; runs of
   neighbours that share 50 bytes give each string's least document.  Where an
   anchor was cut between pieces, the pieces' sorted strings are merged by binary
   search.
4. Shards answer each block with the strings that a smaller document has, and the
   block removes what they cover.

Defined cases: a null or empty text has no bytes; rows with a null id are counted
but neither change nor are matched; rows that repeat an id do not match each other,
as neither id is smaller; fewer than 50 bytes have no string; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints, winnow
from docquarry.llm import textblocks as tb
from docquarry.llm.textblocks import U

LENGTH = 50
GRAM = 25
BLOCK_BYTES = 2 << 20
#: Bytes of one suffix array: its arrays then stay in a core's cache.
PIECE_BYTES = 256 << 10
_ROW = "bucket int, block int, payload binary"
#: Shards for each shuffle partition.
SHARDS = 2
#: Kasai scans advance side by side in this many places.
_LANES = 8192


def _words8(s: np.ndarray, more: int = 0) -> np.ndarray:
    """The eight bytes from each place on (and from so many places behind), as one big-endian number."""
    out = np.zeros(len(s) + more + 8, U)
    out[: len(s)] = s
    for width in (1, 2, 4):
        out[:-width] = (out[:-width] << U(8 * width)) | out[width:]
    return out[: len(s) + more]


def suffix_array(s: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Places of s in the order of the suffixes there."""
    n = len(s)
    first = _words8(s) if words is None else words[:n]
    # a suffix of under eight bytes stands before longer ones with the same padded word
    length = np.minimum(n - np.arange(n), 8).astype(np.int8)
    order = np.argsort(first)
    key = first[order]
    new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    for place in range(max(0, n - 7), n):
        x, y = np.searchsorted(key, first[place], "left"), np.searchsorted(key, first[place], "right")
        order[x:y] = order[x:y][np.argsort(length[order[x:y]], kind="stable")]
        new[x + 1 : y] |= length[order[x + 1 : y]] != length[order[x : y - 1]]
    # a suffix's rank is where its group begins; groups of one are settled
    rank = np.empty(n, np.int64)
    at, h = np.arange(n), 8
    while len(at):
        begin = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = begin
        single = new & np.r_[new[1:], True]
        at, begin = at[~single], begin[~single]
        where = order[at]
        second = np.where(where + h < n, rank[np.minimum(where + h, n - 1)] + 1, 0)
        both = begin * (n + 1) + second
        turn = np.argsort(both)
        order[at], both = where[turn], both[turn]
        new = np.r_[True, both[1:] != both[:-1]] if len(at) else np.zeros(0, bool)
        h *= 2
    return order


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int, words: np.ndarray | None = None) -> np.ndarray:
    """Bytes (up to most) that the suffix at each rank shares with the one before, by Kasai's method.

    The text is cut into lanes that are scanned side by side; a lane's first value
    starts from nothing, the others from their predecessor's less one."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = _words8(s, most + 8) if words is None else words
    by_place = np.zeros(n, np.int64)
    step = -(-n // _LANES) if n else 1
    lane = np.arange(0, n, step)
    have = np.zeros(len(lane), np.int64)
    for t in range(step):
        place = lane + t
        live = place < np.minimum(lane + step, n)
        place, keep = place[live], np.maximum(have[live] - 1, 0)
        other = before[place]
        keep[other < 0] = 0
        act = np.flatnonzero((other >= 0) & (keep < most))
        while len(act):
            a, b = place[act] + keep[act], other[act] + keep[act]
            diff = words[a] ^ words[b]
            # leading equal bytes of the two words, and no further than either suffix goes
            same = np.where(diff == 0, 8, _leading(diff))
            room = n - np.maximum(a, b)
            keep[act] += np.minimum(same, room)
            act = act[(same == 8) & (room > 8) & (keep[act] < most)]
        have[live] = keep
        by_place[place] = keep
    return np.minimum(by_place[order], most)


def _leading(diff: np.ndarray) -> np.ndarray:
    """Leading zero bytes of nonzero 64-bit values."""
    out = np.zeros(len(diff), np.int64)
    for shift in (56, 48, 40, 32, 24, 16, 8):
        out += (diff >> U(shift)) == 0
    return out


def _docs_anchors(table: pa.Table):
    """(table by id, data, off, document index of bytes, prefix sums of bytes, least grams, inside)."""
    tb.reuse_memory()
    table = winnow.sorted_block(table)
    data, off = tb.text_buffers(table["text"])
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    values = tb.BYTE_VALUES[data]
    sums = tb.prefix_sums(values)
    return table, data, off, doc, sums, *winnow.least_grams(values, doc, LENGTH, GRAM, sums)


def _rows(rows) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "block", "payload"])


def _anchor_rows(n: int):
    """Rows (bucket, block, anchors): those met once in the block, then those met more often."""

    def run(key, table):
        *_, anchor, inside = _docs_anchors(table)
        at = winnow.occurrences(anchor, inside)
        a, count = np.unique(tb.mix(anchor[at]), return_counts=True)
        rows = []
        for b, p in winnow.by_bucket(a, n):
            once, often = tb.pack(winnow.low(a[p][count[p] == 1])), tb.pack(winnow.low(a[p][count[p] > 1]))
            rows.append((b, key[0].as_py(), len(once).to_bytes(4, "little") + once + often))
        return _rows(rows)

    return run


def _shared(key, table):
    """To each block the anchors that occur elsewhere, or more than once in it."""
    got = []
    for r in table.to_pylist():
        size = int.from_bytes(r["payload"][:4], "little")
        got.append((r["block"], tb.unpack(r["payload"][4 : 4 + size]), tb.unpack(r["payload"][4 + size :])))
    many, count = np.unique(np.concatenate([x for _, once, often in got for x in (once, often)]), return_counts=True)
    shared = many[count > 1]
    rows = [(key[0].as_py(), b, np.union1d(np.intersect1d(once, shared, assume_unique=True), often)) for b, once, often in got]
    return _rows([(k, b, tb.pack(x)) for k, b, x in rows if len(x)])


def _segments(docs: pa.Table, shared: pa.Table, n: int):
    """The block's segments: (table, data, off, doc of segment, start, windows, anchor, content number, first of each content)."""
    docs, data, off, doc, sums, anchor, inside = _docs_anchors(docs)
    table = winnow.join_shared([(r["bucket"], 0, r["payload"]) for r in shared.to_pylist()])
    runs = winnow.occurrences(anchor, inside)
    keys = tb.mix(anchor[runs])
    known = winnow.among(keys, table, n)
    runs, keys = runs[known], keys[known]
    # a run ends where its anchor or document does
    stop = np.ones(len(anchor) + 1, bool)
    stop[1:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:] | ~inside[:-1]
    ends = np.flatnonzero(stop)
    windows = ends[np.searchsorted(ends, runs, side="right")] - runs
    content = tb.span_hash(sums, runs, runs + windows + LENGTH - 1)
    ids = np.asarray(docs["id"].combine_chunks())
    owner = ids[doc[runs]] if len(runs) else np.zeros(0, np.int64)
    _, first, which = np.unique(content, return_index=True, return_inverse=True)  # documents ascend, so the first is the least
    return docs, data, off, owner, runs, windows, keys, content, first, which


def _by_shard(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of segments by shard and anchor, where each shard's begin and the last one's end)."""
    shard = winnow.bucket_of(anchor, shards)
    order = np.lexsort((winnow.low(anchor), shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _segment_rows(n: int, shards: int):
    """Rows (shard, block, segments): anchors, least documents, window counts, content hashes and bytes."""

    def run(key, docs, shared):
        if docs.num_rows == 0 or shared.num_rows == 0:
            return _rows([])
        _, data, _, owner, runs, windows, anchor, content, first, _ = _segments(docs, shared, n)
        raw = data.tobytes()
        rows = []
        order, cuts = _by_shard(anchor[first], shards)
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                at = first[order[x:y]]
                text = b"".join(raw[p : p + w + LENGTH - 1] for p, w in zip(runs[at].tolist(), windows[at].tolist()))
                rows.append((b, key[0].as_py(), _closed(winnow.low(anchor[at]), owner[at], windows[at], text)))
        return _rows(rows)

    return run


def _closed(anchor: np.ndarray, owner: np.ndarray, windows: np.ndarray, text: bytes) -> bytes:
    """Segments in the order of their anchors: anchors as differences, documents by place in a list, bytes by zstd."""
    used, place = np.unique(owner, return_inverse=True)
    keys = tb.pack(anchor)
    parts = [keys, used.astype("<i8").tobytes(), place.astype("<u4").tobytes(), windows.astype("<u4").tobytes()]
    head = b"".join(len(x).to_bytes(4, "little") for x in parts)
    return head + b"".join(parts) + zstandard.ZstdCompressor(level=3).compress(text)


def _open_segments(raw: bytes):
    """(anchors, documents, content hashes, window counts, bytes); the hashes are those of the sender, from the bytes."""
    sizes = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, 16, 4)]
    cuts = np.cumsum([16, *sizes])
    keys, used, place, windows = (raw[x:y] for x, y in zip(cuts[:-1], cuts[1:]))
    windows = np.frombuffer(windows, "<u4").astype(np.int64)
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[cuts[-1] :]), np.uint8)
    stop = np.cumsum(windows + LENGTH - 1)
    content = tb.span_hash(tb.prefix_sums(tb.BYTE_VALUES[text]), stop - windows - LENGTH + 1, stop)
    return tb.unpack(keys), np.frombuffer(used, "<i8")[np.frombuffer(place, "<u4")], content, windows, text


def _piece_strings(text: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
    """Of one piece: (places of the windows, segment and number of string of each, a place of each string in ascending order, least owner of each)."""
    n = len(text)
    ends = np.cumsum(sizes)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    whole = ends[segment] - np.arange(n) >= LENGTH
    words = _words8(text, LENGTH + 8)
    order = suffix_array(text, words)
    shared = common_prefixes(text, order, LENGTH, words) >= LENGTH
    shared[:1] = False
    string = np.cumsum(~shared)
    keep = whole[order]
    places, string = order[keep], string[keep]
    segment = segment[places]
    # windows of one string stand together
    edge = np.flatnonzero(np.r_[True, string[1:] != string[:-1]]) if len(string) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(owner[segment], edge) if len(edge) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(string)]))
    return places, segment, number, places[edge], least


def _fixed(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The strings at places as fixed-width bytes that compare as they are (no zero bytes: UTF-8 never uses 255)."""
    return np.ascontiguousarray((text[places[:, None] + np.arange(LENGTH)] + 1).astype(np.uint8)).view(f"S{LENGTH}").ravel()


def _merge(pieces: list[dict]) -> None:
    """Least owners across pieces that an anchor was cut between: sorted strings are merged two by two by binary search, then looked up."""
    tables = [(_fixed(x["text"], x["sample"]), x["least"]) for x in pieces]
    own = [strings for strings, _ in tables]
    while len(tables) > 1:
        tables = [_merged(*tables[i], *tables[i + 1]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    strings, least = tables[0]
    for x, mine in zip(pieces, own):
        x["least"] = least[np.searchsorted(strings, mine)]


def _merged(a, least_a, b, least_b):
    """Two sorted lists of strings with their least owners as one."""
    if len(a) == 0 or len(b) == 0:
        return (b, least_b) if len(a) == 0 else (a, least_a)
    at = np.searchsorted(a, b)
    hit = a[np.minimum(at, len(a) - 1)] == b
    least_a = least_a.copy()
    least_a[at[hit]] = np.minimum(least_a[at[hit]], least_b[hit])
    return np.insert(a, at[~hit], b[~hit]), np.insert(least_a, at[~hit], least_b[~hit])


def _cuts(anchor: np.ndarray, sizes: np.ndarray):
    """(from, to, whether the next piece goes on with this one's last anchor) of pieces, cut between anchors if possible."""
    x = group = total = of_group = 0
    for i, size in enumerate(sizes.tolist()):
        if i and anchor[i] != anchor[i - 1]:
            group, of_group = i, 0
        if total and total + size > PIECE_BYTES:
            if group > x:
                yield x, group, False
                x, total = group, of_group
            else:
                yield x, i, group < i
                x, total = i, 0
        total += size
        of_group += size
    if len(sizes):
        yield x, len(sizes), False


def _shard(key, table):
    """To each block: a bit for each of its segments, in order, that has windows that a smaller document has, then a bit for each window of those."""
    tb.reuse_memory()
    block, parts = [], []
    for r in table.to_pylist():
        parts.append(_open_segments(r["payload"]))
        block.append(r["block"])
    held_by = np.cumsum([0, *(len(p[0]) for p in parts)])
    anchor, owner, content, windows, text = (np.concatenate([p[i] for p in parts]) for i in range(5))
    sizes = windows + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    # equal segments of different blocks: one stands for all, under the least owner
    order = np.lexsort((owner, content, anchor))
    new = np.r_[True, (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]
    chosen = order[new]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    # least owner of each window of each chosen segment
    w = windows[chosen]
    wbegin = np.cumsum(w) - w
    best = np.empty(int(w.sum()), np.int64)
    held: list[dict] = []
    for x, y, more in _cuts(anchor[chosen], sizes[chosen]):
        at = chosen[x:y]
        s = sizes[at]
        take = np.repeat(begin[at] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        mine = text[take]
        places, segment, string, sample, least = _piece_strings(mine, s, owner[at])
        held.append({"text": mine, "places": places, "segment": segment, "string": string, "sample": sample, "least": least, "sizes": s, "x": x})
        if more:
            continue  # the next piece has the same anchor
        if len(held) > 1:
            _merge(held)
        for p in held:
            s_begin, seg = np.cumsum(p["sizes"]) - p["sizes"], p["segment"]
            best[(wbegin[p["x"] : p["x"] + len(s_begin)] - s_begin)[seg] + p["places"]] = p["least"][p["string"]]
        held = []
    out: dict[int, list[bytes]] = {}
    # a segment's owner is compared with the least owner of each of its windows
    reps = windows
    src = np.repeat(wbegin[number] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    flag = best[src] < np.repeat(owner, reps)
    stop = np.r_[0, np.cumsum(reps)]
    some = tb.per_doc(flag, stop) > 0
    rows = []
    for b, x, y in zip(block, held_by[:-1], held_by[1:]):
        if some[x:y].any():
            of_some = flag[stop[x] : stop[y]][np.repeat(some[x:y], reps[x:y])]
            rows.append((key[0].as_py(), b, np.packbits(some[x:y]).tobytes() + np.packbits(of_some).tobytes()))
    return _rows(rows)


def _windows(runs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Starts of all windows of segments."""
    return np.repeat(runs - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))


def _result(n: int, shards: int):
    """Per row of a block: n_bytes, n_removed, n_spans and the kept bytes' digest, with the removed spans."""

    def run(key, docs, answers):
        if docs.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        rows = answers.to_pylist()
        shared = pa.table([pa.array([r["bucket"] for r in rows if not r["bits"]], pa.int32()), pa.array([r["payload"] for r in rows if not r["bits"]], pa.binary())], names=["bucket", "payload"])
        docs, data, off, owner, runs, windows, anchor, _, first, which = _segments(docs, shared, n)
        removed = np.zeros(len(data), bool)
        if len(runs):
            later = owner > owner[first][which]
            starts = [_windows(runs[later], windows[later])]
            order, cuts = _by_shard(anchor[first], shards)
            place, bits, at = np.full(len(first), -1, np.int64), [np.zeros(0, np.uint8)], 0
            for r in rows:
                if r["bits"]:
                    sent = order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]
                    raw = np.frombuffer(r["payload"], np.uint8)
                    head = -(-len(sent) // 8)
                    some = sent[np.unpackbits(raw[:head], count=len(sent)) > 0]
                    size = windows[first[some]]
                    place[some] = at + np.cumsum(size) - size
                    bits.append(np.unpackbits(raw[head:], count=int(size.sum())))
                    at += int(size.sum())
            # all segments of the document that has the bytes first, be they repeated there
            own = np.flatnonzero(~later & (place[which] >= 0))
            flag = np.concatenate(bits)[_windows(place[which[own]], windows[own])] > 0
            starts.append(_windows(runs[own], windows[own])[flag])
            removed = tb.cover(np.concatenate(starts).astype(np.int64), LENGTH, len(data))
        head = removed.copy()
        head[1:] &= ~removed[:-1]
        at = off[:-1][off[:-1] < len(data)]
        head[at] = removed[at]
        tail = removed.copy()
        tail[:-1] &= ~removed[1:]
        at = off[1:][off[1:] > 0] - 1
        tail[at] = removed[at]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        digests, spans = [], []
        at = np.searchsorted(heads, off)
        for i in range(docs.num_rows):
            text = data[off[i] : off[i + 1]]
            digests.append(hashlib.sha256(text[~removed[off[i] : off[i + 1]]].tobytes()).hexdigest())
            x, y = at[i], at[i + 1]
            spans.append(np.stack([heads[x:y], tails[x:y]], axis=1).astype("<i8").__sub__(off[i]).tobytes())
        return pa.table([docs["id"], pa.array(np.diff(off)), pa.array(tb.per_doc(removed, off)), pa.array(tb.per_doc(head, off)), pa.array(digests, pa.string()), pa.array(spans, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (pairs of little-endian 64-bit byte offsets) of all rows."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = winnow.rows_of(docs, id_col, text_col)
    batch = winnow.dealt(rows, winnow.count_blocks(rows, BLOCK_BYTES))
    groups = lambda: batch.groupBy("block")
    shared = groups().applyInArrow(_anchor_rows(n), _ROW).groupBy("bucket").applyInArrow(_shared, _ROW)
    shared = checkpoints.cut(shared)
    bits = groups().cogroup(shared.groupBy("block")).applyInArrow(_segment_rows(n, SHARDS * n), _ROW).groupBy("bucket").applyInArrow(_shard, _ROW)
    answers = shared.withColumn("bits", F.lit(False)).unionByName(bits.withColumn("bits", F.lit(True)))
    out = groups().cogroup(answers.groupBy("block")).applyInArrow(_result(n, SHARDS * n), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")
    ident, text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rest = docs.where(ident.isNull() | docs[text_col].isNull() | (docs[text_col].cast("string") == ""))
    zero = F.lit(0).cast("long")
    rest = rest.select(ident.alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), F.lit(b"").alias("spans"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of all documents."""
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
