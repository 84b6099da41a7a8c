"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its 5-word shingles.  Two sets link when their Jaccard
similarity is 0.8 or more, so their sizes differ by a quarter at most and their
symmetric difference holds at most a ninth of the sum of their sizes.

Sizes are cut into bands that grow by a quarter; a set takes part in its own band
and the next, so linked sets always meet in one.  In a band whose sets differ in at
most k shingles, the shingle domain is dealt into first-level partitions, each of
those into ``N2`` second-level ones, and every subset of N2 - K2 second-level ones
gives a signature: the hash of what the set has there.  With more than k / (K2 + 1)
first-level partitions one of them has at most K2 second-level ones that differ, so
one subset is equal.  Subsets where a set has nothing are not enumerated; only a set
with so many of those that they could be all it shares adds its rarest shingles, by
prefix filtering, which is exact for any set.

1. One pass over the texts takes each set's size, two hashes, a parity sketch and the
   signatures of the first ``COARSE`` first-level partitions.  Equal sets go on as one,
   their least document.
2. Coarse signatures link their holders to the least of them, as stars: linear in
   the holders.  Most links are found here, and join documents to components.
3. A second pass sends all signatures, packed by block and hash bucket, with the
   documents' components.  A group of holders gives its pairs between components if it
   is small (``SMALL``), else its members under the least of them.  What has the same
   least member meets once, is sorted by the sketch distance to one of them, and gives
   for each two components the ``NEAREST`` pairs that the sketches cannot rule out.
   Where that number was not enough to find a link or to rule it out, it is raised and
   the members meet again, until nothing is open: so no link is lost.
4. Candidates that a sketch cannot rule out are verified on the whole texts.

Groups of more than ``GROUP_ROWS`` members meet in pairs of chunks, so no task holds
more than two chunks of one.

Defined cases: null, empty and wordless texts have an empty set and their own id
as component; null ids keep a null component and link with nothing; rows that
repeat an id are texts of one document, and a link of any of them is a link of the
document; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints
from docquarry.llm import textblocks as tb
from docquarry.llm.components import components

WORDS = 5
#: Similarity 0.8 as the fraction 4/5.
NUM, DEN = 4, 5
#: Second-level partitions, and how many of them may differ in an agreeing subset.
N2, K2 = 3, 1
#: First-level partitions whose signatures make the coarse stars.
COARSE = 3
SIG_BITS = 40
BLOCK_BYTES = 2 << 20
#: Holders of a signature up to which all pairs between components are taken at once.
SMALL = 8
#: Pairs that two components give at first where they meet in larger groups.
NEAREST = 4
#: Members of a group that one task compares.
GROUP_ROWS = 8192
#: Rows of a few integers up to which a table is broadcast.
BROADCAST_ROWS = 100_000

_LOW = tb.U((1 << SIG_BITS) - 1)
_SUBSETS = list(combinations(range(N2), N2 - K2))
#: Bits of a shingle hash; the others number a block's documents while they are sorted.
_HASH_BITS = 52
_DOCS = 1 << (64 - _HASH_BITS)


def bands(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(least sizes, greatest sizes) of the bands up to a size of most, and one more."""
    lows, highs = [1], [DEN // NUM]
    while highs[-1] < most or len(lows) < 2:
        lows.append(highs[-1] + 1)
        highs.append(lows[-1] * DEN // NUM)
    lows.append(highs[-1] + 1)
    highs.append(lows[-1] * DEN // NUM)
    return np.array(lows), np.array(highs)


def _most_apart(high: np.ndarray) -> np.ndarray:
    """Greatest symmetric difference of linked sets of at most these sizes."""
    return 2 * high * (DEN - NUM) // (DEN + NUM)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets): each document's distinct shingles in ascending order."""
    data, off = tb.text_buffers(texts)
    n = len(off) - 1
    if n > _DOCS:
        parts = [shingle_sets(texts.slice(x, _DOCS)) for x in range(0, n, _DOCS)]
        return np.concatenate([h for h, _ in parts]), np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))]
    data = tb.LOWER[data]
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    words = tb.span_hash(tb.prefix_sums(tb.BYTE_VALUES[data]), starts, ends)
    counts = np.bincount(doc, minlength=n)
    h = tb.window_hash(words, WORDS)
    inside = doc[: len(h)] == doc[WORDS - 1 :] if len(h) else np.zeros(0, bool)
    h, d = h[inside], doc[: len(h)][inside]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = tb.span_hash(tb.prefix_sums(words), first, first + counts[short])
        h, d = np.concatenate([h, whole]), np.concatenate([d, short])
    # one number holds document and hash, so that a plain sort orders both
    key = (d.astype(tb.U) << tb.U(_HASH_BITS)) | (h >> tb.U(64 - _HASH_BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    off = np.searchsorted(key, np.arange(n, dtype=tb.U) << tb.U(_HASH_BITS))
    return key & tb.U((1 << _HASH_BITS) - 1), np.r_[off, len(key)]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Wrapping sums of values over [off[i], off[i + 1])."""
    total = np.zeros(len(values) + 1, tb.U)
    np.cumsum(values, dtype=tb.U, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def set_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    return _sums(tb.mix(h), off), _sums(tb.mix(h ^ tb.U(0x5851F42D4C957F2D)), off)


def signatures(h: np.ndarray, off: np.ndarray, *, coarse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of all sets, for their own band and the next; coarse: of the first partitions only."""
    sizes = np.diff(off)
    out_sig, out_set = [], []
    if len(h) == 0:
        return np.zeros(0, tb.U), np.zeros(0, np.int64)
    low, high = bands(int(sizes.max()))
    own = np.searchsorted(low, np.maximum(sizes, 1), side="right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in (0, 1):
        band = own + step
        spoiled = _most_apart(high)[band] // (K2 + 1)
        # some first-level partitions more than can be spoiled, so that those where a set has too little can be done without
        n1 = spoiled + 2 + spoiled // 10
        parts = n1 * N2
        held_parts = np.minimum(parts, COARSE * N2) if coarse else parts
        begin = np.cumsum(held_parts) - held_parts
        salted = tb.mix(h + (band[owner].astype(tb.U) + tb.U(1)) * tb.U(0x9E3779B97F4A7C15))
        place = ((salted >> tb.U(33)) % parts.astype(tb.U)[owner]).astype(np.int64)
        at_doc = owner
        if coarse:
            first = place < held_parts[owner]
            salted, place, at_doc = salted[first], place[first], owner[first]
        place += begin[at_doc]
        total = int(held_parts.sum())
        value = tb.mix(salted)
        # wrapping 64-bit sums, taken as two exact sums of 32-bit halves
        lo = np.bincount(place, weights=(value & tb.U(0xFFFFFFFF)).astype(float), minlength=total)
        hi = np.bincount(place, weights=(value >> tb.U(32)).astype(float), minlength=total)
        held = np.bincount(place, minlength=total).reshape(-1, N2) > 0
        inner = (lo.astype(tb.U) + (hi.astype(tb.U) << tb.U(32))).reshape(-1, N2)
        groups = held_parts // N2
        which = np.repeat(np.arange(len(sizes)), groups)
        number = np.arange(len(which)) - np.repeat(np.cumsum(groups) - groups, groups)
        label = (number * len(_SUBSETS)).astype(tb.U) + (band[which].astype(tb.U) << tb.U(40))
        for i, subset in enumerate(_SUBSETS):
            full = held[:, list(subset)].any(axis=1)
            s = sum(inner[full, j] * tb.U(2 * j + 3) for j in subset)
            out_sig.append(tb.mix(s + tb.mix(label[full] + tb.U(i))))
            out_set.append(which[full])
        if coarse:
            continue
        # first-level partitions where any agreeing subset has something
        sure = np.bincount(which[(~held).sum(axis=1) < N2 - K2], minlength=len(sizes))
        for i in np.flatnonzero((sizes > 0) & (sure <= spoiled)):
            size = int(sizes[i])
            keep = size - -(-size * NUM // DEN) + 1
            head = h[off[i] : off[i] + keep]
            out_sig.append(tb.mix(head ^ tb.mix(np.full(keep, (int(band[i]) << 40) + (1 << 39), tb.U))))
            out_set.append(np.full(keep, i))
    return np.concatenate(out_sig), np.concatenate(out_set)


def sketches(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): parity of each set's shingles in as many classes as the power of two from twice its size on.

    Bits that differ never outnumber shingles that differ, also after a sketch is
    folded to half its length."""
    sizes = np.diff(off)
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[owner] + (tb.mix(h + tb.U(77)) & (bits - 1).astype(tb.U)[owner]).astype(np.int64)
    odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), np.r_[begin, int(bits.sum())] // 8


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


_FACTS = "id long, n_shingles long, k1 long, k2 long, sketch binary, coarse array<long>"


def _facts(batches):
    """What is known of each row's set."""
    for block in tb.iter_blocks(batches, "text", BLOCK_BYTES):
        h, off = shingle_sets(block["text"].combine_chunks())
        k1, k2 = set_keys(h, off)
        sig, which = signatures(h, off, coarse=True)
        order = np.argsort(which, kind="stable")
        coarse = pa.ListArray.from_arrays(pa.array(np.searchsorted(which[order], np.arange(len(off))), pa.int32()), pa.array(sig[order].view(np.int64)))
        raw, cut = sketches(h, off)
        raw = raw.tobytes()
        held = pa.array([raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
        yield pa.record_batch([block["id"].combine_chunks(), pa.array(np.diff(off)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), held, coarse], names=["id", "n_shingles", "k1", "k2", "sketch", "coarse"])


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _emit_signatures(n_buckets: int):
    """Rows (bucket, payload): a block's signatures there, ascending, with their documents and components."""

    def run(batches):
        for block in tb.iter_blocks(batches, "text", BLOCK_BYTES):
            ids, comp = np.asarray(block["id"]), np.asarray(block["comp"])
            h, off = shingle_sets(block["text"].combine_chunks())
            sig, which = signatures(h, off)
            if len(sig) == 0:
                continue
            bucket = ((sig >> tb.U(48)) * tb.U(n_buckets)) >> tb.U(16)
            key = (bucket << tb.U(SIG_BITS)) | (sig & _LOW)
            order = np.argsort(key)
            key, which = key[order], which[order]
            cuts = np.searchsorted(key, np.arange(n_buckets + 1).astype(tb.U) << tb.U(SIG_BITS))
            rows = []
            for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if y > x:
                    used, local = np.unique(which[x:y], return_inverse=True)
                    kind = "<u2" if len(used) < 1 << 16 else "<u4"
                    head = np.array([len(used), y - x], "<u4").tobytes()
                    rows.append((b, b"".join([head, ids[used].astype("<i8").tobytes(), comp[used].astype("<i8").tobytes(), local.astype(kind).tobytes(), tb.pack(key[x:y] & _LOW)])))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    return run


def _open(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, ids, components) of a payload."""
    n, count = np.frombuffer(raw, "<u4", 2).tolist()
    ids, comp = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    kind = np.dtype("<u2" if n < 1 << 16 else "<u4")
    at = 8 + 16 * n
    place = np.frombuffer(raw, kind, count, at)
    return tb.unpack(raw[at + count * kind.itemsize :]), ids[place], comp[place]


_MET = pa.schema([("whole", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(key, table):
    """Of a bucket's groups with several components: the pairs of small ones, and (least member, member) of others, flagged ``whole``."""
    sig, ids, comp = map(np.concatenate, zip(*(_open(p.as_py()) for p in table["payload"])))
    order = np.argsort(sig, kind="stable")
    sig, ids, comp = sig[order], ids[order], comp[order]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    count = np.diff(np.r_[edge, len(sig)])
    mixed = np.minimum.reduceat(comp, edge) < np.maximum.reduceat(comp, edge)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(2, SMALL + 1):
        begin = edge[mixed & (count == size)]
        for x, y in combinations(range(size), 2):
            apart = comp[begin + x] != comp[begin + y]
            p, q = ids[begin + x][apart], ids[begin + y][apart]
            out_a.append(np.maximum(p, q))
            out_b.append(np.minimum(p, q))
    a, b = _unique_pairs(np.concatenate(out_a), np.concatenate(out_b))
    # a larger group under its least member, with all others that are in a group of that one
    large = np.repeat(mixed & (count > SMALL), count)
    least, member = _unique_pairs(np.repeat(np.minimum.reduceat(ids, edge), count)[large], ids[large])
    whole = np.r_[np.zeros(len(a), bool), np.ones(len(least), bool)]
    a, b = np.r_[a, least], np.r_[b, member]
    return pa.Table.from_arrays([pa.array(whole), pa.array(a), pa.array(b)], schema=_MET)


def _near(size_a, size_b, apart):
    """Whether sets of these sizes that differ in at least so many shingles may be linked."""
    return apart * (DEN + NUM) <= (size_a + size_b) * (DEN - NUM)


def _nearest(rows: np.ndarray, nearest: int) -> np.ndarray:
    """Of rows (component, other component, apart, a, b, more): the nearest of each two components; more: there were others."""
    rows = rows[np.lexsort(rows.T[4::-1])]
    same = (rows[1:, :5] == rows[:-1, :5]).all(axis=1)
    more = np.maximum.accumulate(np.where(rows[:, 5] > 0, np.arange(len(rows)), -1))
    head = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    begin = np.flatnonzero(head)
    end = np.r_[begin[1:], len(rows)]
    rows[:, 5] = np.repeat(more[end - 1] >= begin, end - begin)
    rows = rows[np.r_[True, ~same]]
    head = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    begin = np.flatnonzero(head)
    size = np.diff(np.r_[begin, len(rows)])
    rank = np.arange(len(rows)) - np.repeat(begin, size)
    rows[:, 5] |= np.repeat(size > nearest, size)
    return rows[rank < nearest]


def _between(nearest: int):
    """The nearest pairs (a, b) between any two components of the bucket's parts; more: there are further ones."""

    def run(key, table):
        table = table.take(pa.array(np.argsort(np.asarray(table["part"]), kind="stable")))
        part, ids, comp, sizes = (np.asarray(table[c]) for c in ("part", "id", "comp", "n_shingles"))
        sketch = [np.frombuffer(x.as_py(), "<u8") for x in table["sketch"]]
        edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        held, waiting = [np.zeros((0, 6), np.int64)], 0
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if comp[x:y].min() == comp[x:y].max():
                continue
            words = min(len(s) for s in sketch[x:y])
            bits = np.stack([_folded(s, words) for s in sketch[x:y]])
            # by distance to one member: by the triangle inequality, only those with like distances can be near
            far = np.bitwise_count(bits ^ bits[0]).sum(axis=1, dtype=np.int64)
            turn = np.argsort(far, kind="stable")
            far, bits, i, c, s = far[turn], bits[turn], ids[x:y][turn], comp[x:y][turn], sizes[x:y][turn]
            stop = np.searchsorted(far, far + 2 * int(s.max()) * (DEN - NUM) // (DEN + NUM), side="right")
            for j in range(len(i) - 1):
                other = np.flatnonzero(c[j + 1 : stop[j]] != c[j]) + j + 1
                if len(other) == 0:
                    continue
                apart = np.bitwise_count(bits[other] ^ bits[j]).sum(axis=1, dtype=np.int64)
                near = _near(s[other], s[j], apart)
                if not near.any():
                    continue
                other, apart = other[near], apart[near]
                pairs = [np.maximum(c[other], c[j]), np.minimum(c[other], c[j]), apart, np.maximum(i[other], i[j]), np.minimum(i[other], i[j]), np.zeros_like(apart)]
                held.append(np.stack(pairs, axis=1))
                waiting += len(apart)
                if waiting > 1 << 20:
                    held, waiting = [_nearest(np.concatenate(held), nearest)], 0
        rows = np.concatenate(held)
        rows = _nearest(rows, nearest) if len(rows) else rows
        bucket = pa.array(np.full(len(rows), key[0].as_py()), pa.int64())
        return pa.table([bucket, *(pa.array(rows[:, i]) for i in (3, 4)), pa.array(rows[:, 5] > 0), *(pa.array(rows[:, i]) for i in (0, 1))], names=["bucket", "a", "b", "more", "comp_a", "comp_b"])

    return run


def _squeeze(batches):
    """(id, text as zstd bytes): what is shuffled to be compared."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for block in tb.iter_blocks(batches, "text", BLOCK_BYTES):
        yield pa.record_batch([block["id"].combine_chunks(), pa.array([press.compress(x.as_py().encode()) for x in block["text"]], pa.binary())], names=["id", "text"])


def _unlike(batches):
    """Pairs (a, b) whose sketches cannot rule out a link."""
    for batch in batches:
        size_a, size_b = np.asarray(batch["size_a"]), np.asarray(batch["size_b"])
        apart = np.empty(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch["sketch_a"], batch["sketch_b"])):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            words = min(len(x), len(y))
            apart[i] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(_near(size_a, size_b, apart)))


def _verify(batches):
    """(a, b, linked) of pairs with their texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for block in tb.iter_blocks(batches, "size", BLOCK_BYTES // 2, sized=True):
        n = block.num_rows
        # a hub's text comes with each of its pairs, and is taken apart once
        seen: dict[bytes, int] = {}
        left, right = ([seen.setdefault(x.as_py(), len(seen)) for x in block[c]] for c in ("text_a", "text_b"))
        h, off = shingle_sets(pa.array([press.decompress(x).decode() for x in seen], pa.large_string()))
        linked = np.zeros(n, bool)
        for i in range(n):
            x, y = (h[off[j] : off[j + 1]] for j in (left[i], right[i]))
            if len(x) and len(y):
                at = np.searchsorted(y, x)
                same = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                linked[i] = DEN * same >= NUM * (len(x) + len(y) - same)
        yield pa.record_batch([block["a"].combine_chunks(), block["b"].combine_chunks(), pa.array(linked)], names=["a", "b", "linked"])


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its rows are few; it is counted, so it should be cut before."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of distinct pairs (a, b) of ids that the sketches do not rule out, by the whole texts (id, text)."""
    of = lambda c: facts.select(F.col("id").alias(c), F.col("n_shingles").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    open_ = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    open_ = checkpoints.cut(open_.mapInArrow(_unlike, "a long, b long").distinct())
    used = checkpoints.cut(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    packed = texts.join(_small(used), "id", "left_semi").mapInArrow(_squeeze, "id long, text binary")
    left = open_.join(packed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(packed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.select("a", "b", "text_a", "text_b", (F.octet_length("text_a") + F.octet_length("text_b")).cast("long").alias("size"))
    return checkpoints.cut(both.mapInArrow(_verify, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")))


def buckets(spark: SparkSession) -> int:
    """Hash buckets: as many as the cluster is set to shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _coarse_stars(facts: DataFrame) -> DataFrame:
    """Pairs (a, b): a document, and the least that has one of its coarse signatures."""
    held = facts.select("id", F.explode("coarse").alias("sig"))
    hubs = checkpoints.cut(held.groupBy("sig").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "b"))
    return held.join(hubs, "sig").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _with_label(df: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    """df with the component of a column's documents; those without a link are their own."""
    named = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(named, df[column] == named["_node"], "left").withColumn(to, F.coalesce("_label", column)).drop("_node", "_label")


def _parts(members: DataFrame) -> DataFrame:
    """(part, id) of (group, id): a group is one part, or all pairs of its chunks if it is large."""
    large = members.groupBy("group").count().where(F.col("count") > GROUP_ROWS)
    large = checkpoints.cut(large.select(F.col("group").alias("_group"), F.ceil(F.col("count") / (GROUP_ROWS / 2)).cast("long").alias("chunks")))
    if large.isEmpty():
        return members.select(F.col("group").alias("part"), "id")
    both = members.join(_small(large), members["group"] == large["_group"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine: Column = F.pmod(F.xxhash64("id"), F.col("chunks"))
    each = both.select("group", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("theirs"), "chunks")
    name = F.when(F.col("chunks") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("mine", "theirs"), F.greatest("mine", "theirs")))
    return each.select(name.alias("part"), "id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    n = buckets(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    texts = rows.where("id is not null and text is not null")
    all_facts = checkpoints.cut(rows.mapInArrow(_facts, _FACTS))
    real = all_facts.where("id is not null and n_shingles > 0")
    # sets that several documents have: the least stands for all
    copied = checkpoints.cut(real.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    keys = ["k1", "k2", "n_shingles"]
    known = real.join(_small(copied), keys, "left")
    facts = checkpoints.cut(known.where("first is null or id = first").select("id", "n_shingles", "sketch", "coarse"))
    same = real.select("id", *keys).join(_small(copied), keys).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    same = checkpoints.cut(same.distinct())
    # an id that repeats may be a copy with one text and stand for another
    copies = _small(checkpoints.cut(same.select(F.col("a").alias("id")).distinct().join(facts.select("id"), "id", "left_anti")))
    checked = verified(_coarse_stars(facts), facts, texts)
    links = [same, checked.where("linked").select("a", "b")]
    labels = components(reduce(DataFrame.unionByName, links))
    single = _with_label(texts.join(copies, "id", "left_anti"), _small(labels), "id", "comp")
    met = single.select("id", "text", "comp").mapInArrow(_emit_signatures(n), "bucket int, payload binary")
    met = checkpoints.cut(met.groupBy("bucket").applyInArrow(_meet, "whole boolean, a long, b long").distinct())
    members = _parts(met.where("whole").select(F.col("a").alias("group"), F.col("b").alias("id")))
    members = members.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(4 * n)))
    members = checkpoints.cut(_with_label(members, _small(labels), "id", "comp"))
    pairs, nearest = met.where("not whole").select("a", "b"), NEAREST
    while True:
        grouped = members.join(facts.select("id", "n_shingles", "sketch"), "id").groupBy("bucket")
        close = checkpoints.cut(grouped.applyInArrow(_between(nearest), "bucket long, a long, b long, more boolean, comp_a long, comp_b long"))
        pairs = pairs.unionByName(close.select("a", "b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(pairs, facts, texts)
        checked = checked.unionByName(found)
        if not found.where("linked").isEmpty():
            links.append(found.where("linked").select("a", "b"))
            labels = components(reduce(DataFrame.unionByName, links))
        more = _with_label(_with_label(close.where("more"), _small(labels), "a", "la"), _small(labels), "b", "lb").where("la <> lb")
        more = checkpoints.cut(more.select("bucket", F.explode(F.array("comp_a", "comp_b")).alias("comp")).distinct())
        if more.isEmpty():
            break
        members = members.join(_small(more), ["bucket", "comp"], "left_semi").drop("comp")
        members = checkpoints.cut(_with_label(members, _small(labels), "id", "comp"))
        pairs, nearest = pairs.limit(0), nearest * 32
    out = all_facts.select("id", "n_shingles").join(labels, F.col("id") == labels["node"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "id").alias("component_id"))


def keep_firsts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, with all its columns.

    Of rows that repeat an id, one stays; rows without an id all stay."""
    names = docs.columns
    # names of the caller may clash or repeat: they travel as positions
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    near = checkpoints.cut(near_duplicates(docs, id_col=ident, text_col=text).where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), "component_id"))
    gone = checkpoints.cut(near.where("id <> component_id").select(F.col("id").alias("gone")).distinct())
    repeated = checkpoints.cut(near.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice")))
    of = docs[ident].cast("long")
    out = docs.join(_small(gone), of == F.col("gone"), "left_anti")
    if not repeated.isEmpty():
        once = out.join(repeated, of == F.col("twice"), "left_semi").dropDuplicates([ident])
        out = out.join(repeated, of == F.col("twice"), "left_anti").unionByName(once)
    return out.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.same >= 80 * (x.n + y.n - p.same)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a) SELECT a, min(b) AS c FROM t GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, r.c AS component_id FROM n JOIN r ON r.a = n.doc_id
"""
