"""SimHash near-duplicates, exact within a Hamming radius, by vantage-point trees.

Fingerprints that differ in at most `radius` of 64 bits differ in at most radius // blocks bits of one of `blocks`
runs of bits. For each run, a vantage-point tree partitions the fingerprints by Hamming distance over that run: a
node splits at the median distance to its vantage point, and the triangle bound |d(q,v) - d(p,v)| <= d(q,p) says
which children a query can leave out. Its upper levels, fitted on a bounded sample, are the shards: each
fingerprint lives in one leaf and is also sent to those leaves that its ball overlaps. With four runs and a radius of
3 balls have radius 0 and overlap nothing: four copies of a fingerprint are shuffled, however many shards there are.
Within a shard the tree goes on in memory; fingerprints that it can't tell apart go on to trees over each other run,
one of which differs in at most radius // (blocks - 1) bits. Pairs are compared over all 64 bits. No pair within the
radius is lost, whatever the sample.

Only a spanning forest of the links leaves a shard, so a group of k near copies gives k - 1 links and not k * k.
Rows with the same fingerprint are grouped first; leaves whose share of the sample is large are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.common import as_bytes, map_batches, materialize
from hopweave.llm.components import components

#: Distinct fingerprints that a shard should hold, sample rows for each shard, and the most rows of the sample.
SHARD_ROWS, SAMPLE_PER_SHARD, SAMPLE_MOST = 60_000, 64, 262_144
#: Fingerprints of a leaf that can't be split beyond which it is salted: 17 MB of rows.
LEAF_ROWS = 1_000_000
#: Comparisons that a shard makes at once.
BLOCK = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, word shingles with repeats, XXH64 with seed 42; no word: 0."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(x), 42) for x in zip(*(tokens[i:] for i in range(words)), strict=False)), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs; null and empty texts have 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words) if t else 0 for t in as_bytes(batch.column(1))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """64 bits in runs as even as can be."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def fit_tree(sample: np.ndarray, mask: int, leaf_rows: int) -> list:
    """Nodes (vantage, median, near, far) or (leaf number, sample rows); the root is the first."""
    nodes: list = []
    mask64 = np.uint64(mask)
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        if len(rows) > leaf_rows:
            vantage = rows[0]
            far = np.bitwise_count((rows ^ vantage) & mask64)
            median = int(np.sort(far)[(len(far) - 1) // 2])
            if median == far.max():
                median -= 1
            if median >= 0:
                nodes[at] = (int(vantage), median, grow(rows[far <= median]), grow(rows[far > median]))
                return at
        nodes[at] = (leaves, len(rows))
        leaves += 1
        return at

    grow(sample)
    return nodes


def route(nodes: list, mask: int, radius: int, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf reached: its number, the positions in fps of those that visit it, and which of them live there."""
    mask64 = np.uint64(mask)
    todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        at, who, home = todo.pop()
        if not len(who):
            continue
        if len(nodes[at]) == 2:
            yield nodes[at][0], who, home
            continue
        vantage, median, near, far = nodes[at]
        d = np.bitwise_count((fps[who] ^ np.uint64(vantage)) & mask64).astype(np.int16)
        for child, visits, lives in ((near, d <= median + radius, d <= median), (far, d > median - radius, d > median)):
            todo.append((child, who[visits], (home & lives)[visits]))


def forest(first: np.ndarray, home: np.ndarray, visitors: np.ndarray, masks: list[int], block: int, radius: int) -> np.ndarray:
    """For each of the fingerprints `first`, the one that stands for its component, over the links between `visitors`
    and `home`: at most `radius` bits apart, and at most radius // len(masks) of them under masks[block]."""
    root = np.arange(len(first))

    def find(i: np.ndarray) -> np.ndarray:
        r = root[i]
        while True:
            up = root[r]
            if (up == r).all():
                root[i] = r
                return r
            r = up

    def compare(h: np.ndarray, v: np.ndarray) -> None:
        rows, f = max(1, BLOCK // len(h)), first[h]
        for at in range(0, len(v), rows):
            part = v[at : at + rows]
            apart = find(part)[:, None] != find(h)[None, :]  # what is linked already needs no comparison
            if not apart.any():
                continue
            hit, of = np.nonzero(apart & (np.bitwise_count(first[part][:, None] ^ f[None, :]) <= radius))
            for i, start, end in zip(*_groups(hit), strict=True):
                tops = np.unique(find(np.append(h[of[start:end]], part[i])))
                root[tops] = tops[0]

    # each run that may come next, with its radius; what one doesn't tell apart goes on to all others
    others = [(np.uint64(m), radius // (len(masks) - 1), ()) for i, m in enumerate(masks) if i != block]
    todo = [(home, visitors, np.uint64(masks[block]), radius // len(masks), others)]
    while todo:
        h, v, mask, ball, later = todo.pop()
        if not len(h) or not len(v):
            continue
        if len(h) * len(v) > BLOCK and len(h) > 32:
            vantage = first[h[len(h) // 2]]
            dh = np.bitwise_count((first[h] ^ vantage) & mask).astype(np.int16)
            dv = np.bitwise_count((first[v] ^ vantage) & mask).astype(np.int16)
            median = int(np.sort(dh)[(len(dh) - 1) // 2])
            if median == dh.max():
                median -= 1
            if median < 0:
                v = v[dv <= ball]
            else:
                parts = [(h[dh <= median], v[dv <= median + ball]), (h[dh > median], v[dv > median - ball])]
                if sum(len(a) * len(b) for a, b in parts) < 0.95 * len(h) * len(v):
                    # the smaller part is popped first, so that few wait
                    parts.sort(key=lambda x: -len(x[0]))
                    todo += [(*x, mask, ball, later) for x in parts]
                    continue
            if later:
                todo += [(h, v, *other) for other in later]
                continue
        if len(v):
            compare(h, v)
    return find(np.arange(len(first)))


def _groups(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal neighbours: the value, the first position and the one behind the last."""
    if not len(sorted_ids):
        return sorted_ids, sorted_ids, sorted_ids
    start = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    return sorted_ids[start], start, np.append(start[1:], len(sorted_ids))


def links(fps: DataFrame, radius: int = 3, blocks: int = 4, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """From distinct fingerprints fp to links (a, b) that connect whatever lies within the radius; each table is read
    from what the caller has written, so give a materialized frame."""
    spark = fps.sparkSession
    n = fps.count()
    shards = max(1, -(-n // shard_rows))
    rows = min(SAMPLE_MOST, SAMPLE_PER_SHARD * shards)
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(rows).collect()], np.int64).view(np.uint64)
    block_radius = radius // blocks
    masks = block_masks(blocks)
    trees = [fit_tree(sample, mask, max(1, -(-len(sample) // shards))) for mask in masks]
    # a leaf that can't be split holds more than its share: so many salts
    salts = [{x[0]: max(1, round(x[1] * n / max(1, len(sample)) / leaf_rows)) for x in tree if len(x) == 2} for tree in trees]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (tree, mask) in enumerate(zip(trees, masks, strict=True)):
                for leaf, who, home in route(tree, mask, block_radius, x):
                    s = salts[k][leaf]
                    own = (x[who] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    for salt in range(s):
                        lives = home & (own % np.uint64(s) == salt)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), (k << 40) | (leaf << 16) | salt, np.int64)), pa.array(x[who].view(np.int64)), pa.array(lives)], ["shard", "fp", "home"])

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        top = forest(fp.view(np.uint64), np.flatnonzero(pdf["home"]), np.arange(len(fp)), masks, int(key[0]) >> 40, radius)
        joined = top != np.arange(len(fp))
        return pd.DataFrame({"a": fp[joined], "b": fp[top[joined]]})

    dealt = fps.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * shards)
    return dealt.repartition(parts, "shard").groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 4, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, for every row.

    Whole texts are read, however long; rows with equal fingerprints are always linked, and of equal doc_ids any is the smallest. Null or empty texts have fingerprint zero and link like any other; repeated rows stay repeated; a null doc_id
    keeps its row and takes part, but is never the smallest (a component of null doc_ids alone has null). An empty
    table gives an empty table. Other columns are ignored, whatever they are called.
    """
    fps = materialize(fingerprints(docs, words), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    labels = materialize(components(links(reps, radius, blocks, shard_rows, leaf_rows), "links"), "labels")
    return _classes(fps, reps, labels, "fp").select("doc_id", hexed, "component_id")


#: Texts whose hashes fill a slice, rows of a group of candidates that one task compares, candidates that are compared with
#: a row before the links found are looked at again.
BAND_ROWS, VERIFY = 30_000, 64
#: Hashes of a text that make up a slice's share; how many sets make a hash frequent, and frequent hashes that are known to all.
SLICE_HASHES, FREQUENT, FREQUENT_MOST = 100, 16, 262_144
#: Slices are read one after the other in so many shares at least (and as many as the cluster has cores), and sets whose counts
#: a share holds before it gives them out: 32 MB and as much again while they are added up.
SHARES, TALLY_ROWS = 8, 1 << 21
#: Bits of a hash that the filter keeps; the upper ones name the slice, 32 stay.
LOW_BITS = 48
_TOP = LOW_BITS - 32


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The hashes of the different word shingles of a text, in order; a text of fewer words is one shingle, no word none."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = {digest(join(x), 42) for x in zip(*(tokens[i:] for i in range(words)), strict=False)} or {digest(join(tokens), 42)}
    return np.sort(np.fromiter(shingles, np.uint64, len(shingles)))


def _least(n, num: int, den: int):
    """The least whole number that isn't below num / den of n."""
    return -(-n * num // den)


def low_rows(n, num: int, den: int):
    """How many of its smallest hashes a set of n shows to the filter."""
    return np.minimum(n, 2 * (n - _least(n, num, den)) + 1)


def low_shared(n, num: int, den: int):
    """How many of them other sets must show too, if one of those is similar.

    Sets with similarity num / den share at least _least(n) of the larger one's hashes. Of the two shown runs one ends
    first; all but n - _least(n) of its hashes are shared, and those lie within the other run as well. The bound grows
    with n, so the smallest size that a partner may have gives the least.
    """
    m = _least(n, num, den)
    return np.minimum(_least(m, num, den), m - _least(m, num, den) + 1)


def size_bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """The first size of each band; partners of sizes in one band are in this, the next or the one before."""
    first = [0, 1]
    while first[-1] < most:
        first.append(first[-1] * den // num + 1)
    return np.array(first)


def slices_for(hashes: int, band_rows: int) -> int:
    """A power of two, so that a slice is the upper bits of a hash."""
    return 1 << min(_TOP, max(0, -(-hashes // (SLICE_HASHES * band_rows)) - 1).bit_length())


def shares_for(cores: int) -> int:
    """A power of two, so that a share is the upper bits of a slice. The input has no say in it: a set's counts come from each share."""
    return 1 << min(_TOP, (max(SHARES, cores) - 1).bit_length())


def place(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The name of each hash in the filter: its slice, then 32 bits. A function of the hash's lowest LOW_BITS bits."""
    low = hashes & np.uint64((1 << LOW_BITS) - 1)
    return ((low >> np.uint64(LOW_BITS - slices.bit_length() + 1)) << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))


def cut(names: np.ndarray, of: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """For each slice: its number, the 32 bits of the hashes named, how many each set has there, and the sets' columns.
    Each hash is in one slice alone, however many slices there are; `of` is the position in columns of each hash's set."""
    order = np.lexsort((of, names >> np.uint64(32)))
    names, of = names[order], of[order]
    for number, start, end in zip(*_groups(names >> np.uint64(32)), strict=True):
        who, first, last = _groups(of[start:end])
        yield int(number), [(names[start:end] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (last - first).astype("<u4").tobytes(), *(c[who].tobytes() for c in columns)]


def seen_elsewhere(names: np.ndarray, band: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the hashes of a slice: the sets that share some with another set of their band or one next to it, and how many;
    the hashes that FREQUENT sets or more have, and how many have them. A set counts once, however often it is repeated."""
    order = np.lexsort((ids, band, names))
    names, band, ids = names[order], band[order], ids[order]
    new = np.append(True, (names[1:] != names[:-1]) | (ids[1:] != ids[:-1]))[: len(names)]
    names, band, ids = names[new], band[new], ids[new]
    next_ = (names[1:] == names[:-1]) & (band[1:] - band[:-1] <= 1)
    who, shared = np.unique(ids[np.append(False, next_)[: len(ids)] | np.append(next_, False)[: len(ids)]], return_counts=True)
    value, first, last = _groups(names)
    often = last - first >= FREQUENT
    return who, shared, value[often], (last - first)[often]


def tally(counts: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and counts added up by id, however many parts they come in; once there are more than `most` ids, those are given out
    and it goes on with the next, so that an id may come again."""
    held, rows = [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        who, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, at, np.concatenate([x[1] for x in held]))
        return who, total

    for part in counts:
        held.append(part)
        # what is added up waits until as much has come again
        if sum(len(x[0]) for x in held) > max(2 * rows, most // 8):
            held = [added()]
            rows = len(held[0][0])
            if rows > most:
                yield held[0]
                held, rows = [], 0
    if held:
        yield added()


def chains(token: np.ndarray, n: np.ndarray, ids: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect sets with a common token: in order of size, each with the first of those from which sizes grow by
    steps that allow a link. Sizes that rule out a step rule out a link across it. k sets give k - 1 pairs at most."""
    order = np.lexsort((ids, n, token))
    token, n, ids = token[order], n[order], ids[order]
    start = np.append(True, (token[1:] != token[:-1]) | (n[:-1] * den < n[1:] * num))[: len(ids)]
    head = ids[np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))]
    pairs = np.unique(np.stack([ids, head])[:, ids != head], axis=1)
    return pairs[0], pairs[1]


def jaccard_forest(sets: list[np.ndarray], home: np.ndarray, num: int, den: int, near: np.ndarray | None = None) -> np.ndarray:
    """For each set, the one that stands for its component, over links of Jaccard similarity num / den or more between
    a set of `home` and any other.

    near: the SimHash class of each set. Those of a class are candidates first, each with the first of its class. Sets
    that are similar share one of their n - _least(n) + 1 rarest hashes: these give the other candidates. All hashes
    decide in both cases, and candidates in one component already aren't compared.
    """
    n = np.array([len(x) for x in sets], np.int64)
    root = np.arange(len(n))
    if not n.sum():
        return root
    ends = np.cumsum(n)
    starts = ends - n
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    often, code = np.sort(often), rank[code]
    of = np.repeat(np.arange(len(n)), n)
    code = code[np.lexsort((code, of))]
    shown = (np.arange(len(code)) - starts[of] < (n - _least(n, num, den) + 1)[of]) & (often[code] > 1)
    by = np.flatnonzero(shown)[np.argsort(code[shown], kind="stable")]
    posted, keys = of[by], code[by]
    value, first, last = _groups(keys)
    at = dict(zip(value.tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))

    def find(i: np.ndarray) -> np.ndarray:
        r = root[i]
        while (root[r] != r).any():
            r = root[r]
        root[i] = r
        return r

    seen, mark = np.zeros(len(n), bool), np.zeros(len(often), bool)

    def check(x: int, y: np.ndarray) -> None:
        y = y[np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num]
        mark[code[starts[x] : ends[x]]] = True
        while len(y := y[find(y) != find(np.array([x]))]):
            part, y = y[:VERIFY], y[VERIFY:]
            both = np.array([np.count_nonzero(mark[code[starts[i] : ends[i]]]) for i in part.tolist()])
            alike = part[both * den >= num * (n[part] + n[x] - both)]
            if len(alike):
                tops = np.unique(find(np.append(alike, x)))
                root[tops] = tops[0]
        mark[code[starts[x] : ends[x]]] = False

    if near is not None:
        order = np.argsort(near, kind="stable")
        for _, a, b in zip(*_groups(near[order]), strict=True):
            if b - a > 1:
                x, y = int(order[a]), order[a + 1 : b]
                check(x, y if home[x] else y[home[y]])
    for x in np.flatnonzero(home).tolist():
        seen[:] = False
        for c in code[starts[x] : ends[x]][shown[starts[x] : ends[x]]].tolist():
            a, b = at[c]
            seen[posted[a:b]] = True
        y = np.flatnonzero(seen)
        check(x, y[(y != x) & ~(home[y] & (y < x))])
    return find(np.arange(len(n)))


def similar_sets(docs: DataFrame, words: int = 5, similarity: float = 0.8, band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame]:
    """doc_id, t (the text's digest) and id (of its set of word shingles) of each row of docs; and labels(node, root) of the
    ids that are linked: those whose sets have a Jaccard similarity of `similarity` or more.

    Rows with equal sets are grouped. The fingerprints of near_duplicates() and their links() come first: whatever lies
    within three bits is a class, and its sets are compared with each other. A similarity is no distance of 64 bits, so
    all hashes decide each link, and what lies further apart is found by the hashes. Each set shows its smallest, cut to 48 bits: where too few of them
    occur in another set of about its size (low_shared()), no set is similar, and equal cuts of unequal hashes only let
    more pass. Sets that pass are made again from the text. Those that are similar share one of their
    n - _least(n) + 1 rarest hashes, so chains() of the sets that share one connect them; what is connected is compared
    in one place, classes first, and each link is decided by all 64-bit hashes. No link is lost and none is added, but for equal hashes
    of unequal shingles.

    Hashes are dealt by value in slices and sets by what they are connected with: each is shuffled once, however many
    shards there are. A task reads a share of the slices, one at a time, and adds up what a set has in them: a set gives a
    row for each share, and shares follow the cluster, not the input (beyond TALLY_ROWS sets in a share, some rows more). Only a connected group of more than band_rows sets is dealt to several shards, whole to each, as
    one set of a shard is compared with all of the group.
    """
    exact = Fraction(str(similarity))
    num, den = exact.numerator, exact.denominator
    bands = size_bands(num, den)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ids(sets: list[np.ndarray]) -> pa.Array:
        return pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))

    def show(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in as_bytes(batch.column(1))]
        sets, fp = [shingle_set(t, words) for t in texts], np.array([fingerprint(t) for t in texts], np.uint64)
        n = np.array([len(x) for x in sets], np.int64)
        shown = low_rows(n, num, den)
        low = [x[:k].view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes() for x, k in zip(sets, shown.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(low_shared(n, num, den)), ids(sets), pa.array(fp.view(np.int64)), pa.array(low, pa.binary())], ["doc_id", "t", "n", "least", "id", "fp", "low"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t or b"", words) for t in as_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([ids(sets), batch.column(1), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["id", "near", "hashes"])

    def deal_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, low = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            of = np.repeat(np.arange(len(low)), [len(x) * 8 // LOW_BITS for x in low])
            hashes = np.zeros((len(of), 8), np.uint8)
            hashes[:, : LOW_BITS // 8] = np.frombuffer(b"".join(low), np.uint8).reshape(-1, LOW_BITS // 8)
            band = np.searchsorted(bands, n, "right").astype("<u2")
            yield from blobs(place(hashes.view("<u8").ravel(), slices), of, [own.astype("<i8"), band], "band")

    def blobs(names: np.ndarray, of: np.ndarray, columns: list[np.ndarray], last: str) -> Iterator[pa.RecordBatch]:
        rows = list(cut(names, of, columns))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*(x[1] for x in rows), strict=True))], ["slice", "names", "counts", "ids", last])

    def opened(pdf: pd.DataFrame, kind: str, last: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4")
        return np.frombuffer(b"".join(pdf["names"]), "<u4"), np.repeat(np.frombuffer(b"".join(pdf[last]), kind).astype(np.int64), counts), np.repeat(np.frombuffer(b"".join(pdf["ids"]), "<i8"), counts)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The slices of a share, which come in order: number, names, bands and ids."""
        held: list[pa.RecordBatch] = []

        def whole_slice() -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            pdf = pa.Table.from_batches(held).to_pandas()
            held.clear()
            return int(pdf["slice"].iloc[0]), opened(pdf, "<u2", "band")

        last = -1
        for batch in filter(len, batches):
            for number, start, end in zip(*_groups(batch.column("slice").to_numpy()), strict=True):
                if held and last != number:
                    yield whole_slice()
                held.append(batch.slice(start, end - start))
                last = number
        if held:
            yield whole_slice()

    def in_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(of_hash: bool, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), of_hash)), pa.array(key), pa.array(value.astype(np.int64))], ["of_hash", "key", "value"])

        frequent_here: list[pa.RecordBatch] = []

        def counts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for number, read in one_by_one(batches):
                who, shared, value, often = seen_elsewhere(*read)
                frequent_here.append(rows(True, (number << 32) | value.astype(np.int64), often))
                yield who, shared

        for who, shared in tally(counts(), TALLY_ROWS):
            yield rows(False, who, shared)
        yield from frequent_here

    def deal_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for batch in filter(len, batches):
            own, near, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            of, hashes = np.repeat(np.arange(len(n)), n), np.concatenate(sets)
            name = place(hashes, slices)
            at = np.searchsorted(known, name)
            often = np.where(known[np.minimum(at, len(known) - 1)] == name, times[np.minimum(at, len(known) - 1)], 0) if len(known) else np.zeros(len(name), np.int64)
            order = np.lexsort((hashes, often, of))
            shown = np.arange(len(of)) - (np.cumsum(n) - n)[of] < (n - _least(n, num, den) + 1)[of]
            # the class is one more of a set's tokens
            name = np.append(name[order][shown], place(near.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), slices))
            yield from blobs(name, np.append(of[shown], np.arange(len(n))), [own.astype("<i8"), n.astype("<i8")], "n")

    def connect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, n, own = opened(pdf, "<i8", "n")
        a, b = chains(names, n, own, num, den)
        return pd.DataFrame({"a": a, "b": b})

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        same = pdf["id"].to_numpy()
        top = jaccard_forest([np.frombuffer(x, "<u8") for x in pdf["hashes"]], pdf["home"].to_numpy(bool), num, den, pdf["near"].to_numpy())
        joined = top != np.arange(len(same))
        return pd.DataFrame({"a": same[joined], "b": same[top[joined]]})

    blob = "slice long, names binary, counts binary, ids binary, "
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    shown = materialize(map_batches(given, lambda: show, "doc_id long, t long, n long, least long, id long, fp long, low binary"), "shown")
    fps = materialize(shown.where("n > 0").select("fp").distinct(), "distinct")
    classes = materialize(components(links(fps), "near"), "classes").withColumnRenamed("node", "fp")
    shares = shares_for(spark.sparkContext.defaultParallelism)
    slices = max(shares, slices_for((shown.agg(F.sum(F.length("low"))).head()[0] or 0) * 8 // LOW_BITS, band_rows))
    dealt = shown.where("n > 0").select("id", "n", "low").mapInArrow(deal_low, blob + "band binary")
    by_share = dealt.repartitionById(shares, F.expr(f"cast(slice div {slices // shares} as int)")).sortWithinPartitions("slice")
    found = materialize(by_share.mapInArrow(in_share, "of_hash boolean, key long, value long"), "found")
    top = found.where("of_hash").orderBy(F.desc("value"), "key").limit(FREQUENT_MOST).select("key", "value").toPandas().sort_values("key")
    frequent = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64).view(np.uint64), top["value"].to_numpy(np.int64)))
    reps = shown.where("n > 0").groupBy("id", "least").agg(_first(), F.min("fp").alias("fp")).select("id", "least", "one.doc_id", "one.t", "fp")
    shared = found.where("not of_hash").groupBy(F.col("key").alias("id")).agg(F.sum("value").alias("shared"))
    wanted = reps.join(shared, "id").where("shared >= least").join(classes, "fp", "left").select("doc_id", "t", F.coalesce("root", "fp").alias("near"))
    chosen = given.alias("g").join(wanted.alias("w"), F.expr("g.t = w.t and g.doc_id <=> w.doc_id")).select("text", "near")
    sets = materialize(map_batches(chosen, lambda: whole, "id long, near long, hashes binary"), "sets")
    edges = sets.mapInArrow(deal_tokens, blob + "n binary").repartition(max(parts, slices), "slice").groupBy("slice").applyInPandas(connect, "a long, b long")
    groups = materialize(components(edges, "candidates"), "groups")
    # a group beyond band_rows is dealt whole to each of its shards; there are few such
    large = groups.groupBy("root").count().where(F.col("count") > band_rows).select("root", F.ceil(F.col("count") / band_rows).cast("int").alias("salts"))
    bins = max(parts, -(-groups.count() // band_rows) * 8)
    shards = groups.join(large, "root", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    shards = shards.select(F.col("node").alias("id"), F.when(F.col("salts") > 1, F.xxhash64("root", "salt")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("shard"), (F.pmod(F.xxhash64("node"), "salts") == F.col("salt")).alias("home"))
    found_links = sets.join(shards, "id").repartition(bins, "shard").groupBy("shard").applyInPandas(join, "a long, b long")
    return shown.select("doc_id", "t", "id"), materialize(components(found_links, "links"), "labels")


def _first() -> F.Column:
    """Which row stands for others: by doc_id, nulls last, then by the text's digest."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id and component_id of each row of docs, over links between texts whose sets of word shingles have a Jaccard
    similarity of `similarity` or more. Edge cases are those of near_duplicates()."""
    rows, labels = similar_sets(docs, words, similarity, band_rows)
    reps = rows.groupBy("id").agg(F.min("doc_id").alias("least"))
    return _classes(rows.select("doc_id", "id"), reps, labels, "id").select("doc_id", "component_id")


def _classes(fps: DataFrame, reps: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """fps with component_id: the smallest `least` of the reps that the links connect."""
    tops = labels.join(reps, labels.node == reps[key]).groupBy("root").agg(F.min("least").alias("least"))
    lower = labels.join(tops, "root").select(F.col("node").alias(key), F.col("least").alias("linked"))
    classes = reps.join(lower, key, "left").select(key, F.coalesce("linked", "least").alias("component_id"))
    return fps.join(classes, key)


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar(); columns stay as they are.

    Rows are told apart by doc_id and text: the one that stays has the smallest doc_id (nulls last), then the smallest digest
    of its text; rows that repeat both leave one of them. A repeated doc_id with an unlike text keeps both rows. Null and empty
    texts, and those without words, are alike and leave one; rows with a null doc_id take part like any other. Very long texts
    are compared as a whole. An empty table gives an empty table.
    """
    rows, labels = similar_sets(docs, words, similarity)
    roots = labels.withColumnRenamed("node", "id")
    stays = rows.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(_first()).select("one.doc_id", "one.t")
    # a semi-join and a grouping by one key: texts are shuffled once
    key = "key" + "_" * max(map(len, docs.columns))
    keys = stays.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "t").alias(key))
    named = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.xxhash64("text")))
    return named.join(keys, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
