"""SimHash near-duplicate groups over a Gray-order hierarchical index.

A document's fingerprint is 64 bits wide. Distinct fingerprints are dealt by three disjoint bit
masks, so that two fingerprints that differ in two bits or fewer agree on one mask at least. The
fingerprints of a shared masked pattern are sorted by Gray rank, and runs of them are factored
into a tree: an upper node holds the bits that all codes below it share. A search walks the tree
from the top, adds up the differences on the bits that each node fixes anew, and leaves a whole
group once the sum passes the limit. A group emits a star of links for each of its components,
never all pairs.

A few differing bits of 64 mean almost equal texts. For a similarity of word shingles wider
fingerprints propose candidates, which meet by samples of their bits, and the exact similarity of
the candidates' shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.llm.common import fresh, in_tasks, materialize
from veldt.llm.components import connected_components

BITS = 64
WIDE = 8  # words of a wide fingerprint
KEY_BITS = 12  # least width of the bit samples by which wide fingerprints meet
MEETING = 256  # fingerprints that meet by chance in a sample, on average; wider samples keep it below that
MISS = 0.002  # chance that two fingerprints at the similarity meet in no sample
DENSE = 64  # larger groups that meet are not compared in one go
FEW = 6  # in larger components the nearest candidates go first, then the pairs that these left apart
NEAREST = 2
FAN = 8  # children of a node of the index
QUERIES = 512  # searches that walk the tree together
#: A byte's bits, spread over eight byte-wide counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(np.uint64).ravel()


def _majority(rows: np.ndarray) -> int:
    """The bits set in over half of the big-endian 64-bit hashes, a row of eight bytes each."""
    n, counts = len(rows), np.zeros((8, 8), np.int64)
    for at in range(0, n, 255 * 256):
        part = _SPREAD[rows[at : at + 255 * 256]]
        short = -len(part) % 255
        if short:
            part = np.concatenate([part, np.zeros((short, 8), np.uint64)])
        sums = np.ascontiguousarray(part.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64))
        counts += sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts.ravel() > n).tobytes(), "big")


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text; 0 for null and for texts without words.

    Words are separated by ASCII white space and A-Z are lower-cased. Repeated shingles count
    each time; a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(h(b" ".join(words), seed), "big")
    runs = zip(*(words[i:] for i in range(shingle)))
    return _majority(np.frombuffer(b"".join([h(x, seed) for x in map(b" ".join, runs)]), np.uint8).reshape(-1, 8))


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_digest
    runs = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.frombuffer(b"".join([h(x, seed) for x in runs]), np.uint64))


def _wide(hashed: np.ndarray) -> bytes:
    if not len(hashed):
        return bytes(8 * WIDE)
    out = []
    for k in range(WIDE):
        x = hashed + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        out.append(_majority(x.view(np.uint8).reshape(-1, 8)).to_bytes(8, "big"))
    return b"".join(out)


def wide_simhash(text: str | None, shingle: int = 5, seed: int = 42) -> bytes:
    """A fingerprint of ``WIDE`` 64-bit words, each from hashes that are mixed anew; zeros without words.

    Repeated shingles count once, as in the sets whose similarity it shows.
    """
    return _wide(shingle_set(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint: the fingerprint's bits as a signed number) for every row; rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((simhash(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_tasks, run, f"id {kind}, fp bigint")


def _gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of each level, leaves first; mask: the bits all codes below a node share."""
    low, high = codes, codes
    out = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(low) > FAN:
        at = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        out.append((low, ~(low ^ high)))
    return out


def _settle(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of linked places; a root is the smallest place of its component."""
    while len(a):
        x, y = roots[a], roots[b]
        if not (apart := x != y).any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := roots[roots], roots):
            roots = up
    return roots


def group_roots(codes: np.ndarray, max_bits: int = 2) -> np.ndarray:
    """For codes in Gray order, the smallest place in each code's component of links."""
    levels, n = _levels(codes), len(codes)
    roots = np.arange(n)
    for at in range(0, n, QUERIES):
        asks = np.arange(at, min(n, at + QUERIES))
        # A node whose codes are in one component already has nothing to add to that component.
        one = [roots]
        for _ in levels[1:]:
            cuts = np.arange(0, len(one[-1]), FAN)
            low, high = np.minimum.reduceat(one[-1], cuts), np.maximum.reduceat(one[-1], cuts)
            least = np.minimum.reduceat(np.where(one[-1] < 0, -1, one[-1]), cuts)
            one.append(np.where((low == high) & (least >= 0), low, -1))
        top = len(levels) - 1
        q = np.repeat(asks, len(levels[top][0]))
        node = np.tile(np.arange(len(levels[top][0])), len(asks))
        fixed, diff = np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            pattern, mask = levels[level]
            last = np.minimum((node + 1) * FAN**level, n) - 1
            keep = (last > q) & (one[level][node] != roots[q])
            q, node, fixed, diff = q[keep], node[keep], fixed[keep], diff[keep]
            diff = diff + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node] & ~fixed)
            near = diff <= max_bits
            q, node, diff = q[near], node[near], diff[near]
            if level:
                fixed = mask[node]
                below = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, fixed, diff = (np.repeat(x, FAN) for x in (q, fixed, diff))
                there = below < len(levels[level - 1][0])
                q, node, fixed, diff = q[there], below[there], fixed[there], diff[there]
        roots = _settle(roots, q, node)
    return roots


def _stars(band: np.ndarray, key: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links inside every run of equal (band, key)."""
    a, b = [], []
    cut = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(codes)]])
    size = ends - starts
    pair = starts[size == 2]
    near = pair[np.bitwise_count(codes[pair] ^ codes[pair + 1]) <= max_bits]
    a.append(codes[near]), b.append(codes[near + 1])
    for s, e in zip(starts[size > 2], ends[size > 2]):
        own = codes[s:e]
        own = own[np.argsort(_gray_rank(own), kind="stable")]
        roots = group_roots(own, max_bits)
        leaf = np.flatnonzero(roots != np.arange(len(own)))
        a.append(own[roots[leaf]]), b.append(own[leaf])
    return np.concatenate(a), np.concatenate(b)


def hamming_links(codes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly the ``fp`` values within ``max_bits`` of each other.

    ``codes`` has one column ``fp`` (bigint) of distinct values. ``max_bits`` + 1 masks cover the
    64 bits, so a linked pair shares a masked pattern. Of the pairs, a spanning star for each
    component of each pattern's group comes out: as many rows as codes and masks at most.
    """
    edges = np.linspace(0, BITS, max_bits + 2).round().astype(int)
    masks = [((1 << int(e)) - 1) ^ ((1 << int(s)) - 1) for s, e in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = codes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("n"), "fp")
    dealt = dealt.select("n.band", "n.key", "fp").repartition("band", "key").sortWithinPartitions("band", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            open_at = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = open_at[-1] + 1 if len(open_at) else 0
            if cut:  # the last run may go on in the next batch
                yield _links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield _links(held)

    def _links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _stars(rows[0], rows[1], rows[2].view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.transform(in_tasks, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: (id, fp, component_id).

    ``component_id`` is the smallest id reachable over fingerprints that differ in ``max_bits``
    bits or fewer, the row's own included. Equal fingerprints link at distance 0, the zero
    fingerprint of null and word-free texts too. Rows with a null id keep a row; their component
    takes the smallest id that is not null, or null if there is none. Repeated rows come out
    repeatedly. Extra columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    codes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(hamming_links(codes.select("fp"), max_bits))
    classes = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written first, so that the join has plain shuffles on both sides and a large component's rows can be split.
    lowest = materialize(classes.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = classes.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def similar_bits(similarity: float) -> int:
    """The most differing bits of wide fingerprints that are worth an exact look at a Jaccard similarity.

    Sets of equal size with similarity j have a cosine of 2 j / (1 + j), of other sizes a larger
    one, and a bit differs with the probability of their angle over pi. The margin is three standard
    deviations: of pairs just at the similarity one in 700 is not looked at.
    """
    p, n = _differ(similarity), BITS * WIDE
    return round(n * p + 3 * math.sqrt(n * p * (1 - p)))


def _differ(similarity: float) -> float:
    """Chance that a bit of two fingerprints differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sample_places(n: int, similarity: float) -> np.ndarray:
    """The places of the bits of each sample, for ``n`` fingerprints.

    Samples widen with the table, so that chance meetings stay few, and wider samples are more, so
    that the chance to meet stays the same.
    """
    width = max(KEY_BITS, math.ceil(math.log2(max(1, n) / MEETING)))
    samples = math.ceil(math.log(MISS) / math.log1p(-((1 - _differ(similarity)) ** width))) if similarity < 1 else 1
    rng = np.random.default_rng(64)
    each = BITS * WIDE // width  # samples of one permutation share no bit
    dealt = [rng.permutation(BITS * WIDE)[: each * width].reshape(each, width) for _ in range(-(-samples // each))]
    return np.concatenate(dealt)[:samples]


def _near_in_group(wide: np.ndarray, most: int) -> np.ndarray:
    """The smallest place in each fingerprint's component; codes of one component are not compared again."""
    roots = np.arange(len(wide))
    for i in range(len(wide) - 1):
        other = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
        if len(other):
            near = other[np.bitwise_count(wide[other] ^ wide[i]).sum(axis=1, dtype=np.int64) <= most]
            if len(near):
                roots = _settle(roots, np.full(len(near), i), near)
    return roots


def _sample_keys(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each wide fingerprint in each sample, a row of keys a fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8 * WIDE), axis=1)
    powers = 1 << np.arange(places.shape[1], dtype=np.int64)
    return np.stack([bits[:, p] @ powers for p in places], axis=1)


def _near(codes: np.ndarray, rows: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (in ``rows``, in ``others``) within ``most`` bits of each other."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 18) // max(1, len(others)))
    for at in range(0, len(rows), step):
        i, j = np.nonzero(np.bitwise_count(codes[rows[at : at + step], None] ^ codes[others]).sum(axis=2, dtype=np.int64) <= most)
        a.append(rows[at + i]), b.append(others[j])
    return np.concatenate(a), np.concatenate(b)


def _candidates_in_group(codes: np.ndarray, most: int, roots: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places (a, b) of near fingerprints of one meeting group, and whether they stand for a dense component.

    Without ``roots`` dense components give each code's nearest ones in place of all pairs. With ``roots`` the pairs of different roots come out.
    """
    n = len(codes)
    if roots is not None:
        names, own, size = np.unique(roots, return_inverse=True, return_counts=True)
        rest, every = np.flatnonzero(own != size.argmax()), np.arange(n)
        for at in range(0, len(rest), 1024):
            a, b = _near(codes, rest[at : at + 1024], every, most)
            keep = (own[a] != own[b]) & ((a < b) | (own[b] == size.argmax()))
            yield a[keep], b[keep], False
        return
    if n <= DENSE:
        a, b = _near(codes, np.arange(n), np.arange(n), most)
        a, b = a[a < b], b[a < b]
        if len(a) < FEW:  # too few for a component of more
            yield a, b, False
            return
        found = _settle(np.arange(n), a, b)
    else:
        found = _near_in_group(codes, most)
    order = np.argsort(found, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(found[order])) + 1):
        if len(part) <= FEW:
            a, b = _near(codes, part, part, most)
            yield a[a < b], b[a < b], False
        else:
            yield from _nearest(codes, part, most)


def _nearest(codes: np.ndarray, part: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places (a, b) of each member of ``part`` and those next to it, ``NEAREST`` of them."""
    step = max(1, (1 << 18) // len(part))
    for at in range(0, len(part), step):
        own = part[at : at + step]
        apart = np.bitwise_count(codes[own, None] ^ codes[part]).sum(axis=2, dtype=np.int64)
        apart[np.arange(len(own)), np.arange(at, at + len(own))] = BITS * WIDE + 1
        near = np.argpartition(apart, NEAREST, axis=1)[:, :NEAREST]
        good = np.take_along_axis(apart, near, axis=1) <= most
        yield np.repeat(own, NEAREST)[good.ravel()], part[near.ravel()][good.ravel()], True


def similar_candidates(wide: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Candidate links (a, b, star) of wide fingerprints; ``star`` marks the nearest of dense components, other pairs come out once.

    ``wide`` has distinct rows (node: bigint, bits: binary) and may have the columns (root, size, shared: bigint) of ``shared_hashes``. Two
    fingerprints meet if all bits of one of the samples agree, and are candidates if they differ in ``similar_bits`` or fewer. A pair belongs to the first sample in
    which it meets. In dense components of a meeting group each code gives its nearest ones only, as
    many rows as codes; with roots, the pairs of different roots come out, however dense, unless they share too few hashes to be similar.
    """
    most, rooted = similar_bits(similarity), "root" in wide.columns
    extra = ["root", "size", "shared"] if rooted else []
    places = sample_places(wide.count(), similarity)
    samples, width = places.shape

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, WIDE)
                keys = (_sample_keys(codes, places) | np.arange(samples) << width).T.ravel()
                order = pa.array(np.tile(np.arange(part.num_rows), samples))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(order) for c in part.columns)], ["key", *part.schema.names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE)]
            now += [batch.column(3 + k).to_numpy() for k in range(len(extra))]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            open_at = np.flatnonzero(held[0] != held[0][-1])
            cut = open_at[-1] + 1 if len(open_at) else 0
            if cut:
                yield from pairs(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)

    def pairs(key: np.ndarray, node: np.ndarray, codes: np.ndarray, roots: np.ndarray | None = None, size_of: np.ndarray | None = None, shared: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        def open_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which pairs have different roots, and enough hashes that others have too: these alone can be in both sets."""
            if roots is None:
                return np.ones(len(i), bool)
            common = np.minimum(shared[i], shared[j])
            return (roots[i] != roots[j]) & (common / (size_of[i] + size_of[j] - common) >= similarity)

        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        few = np.repeat(np.where(size <= FEW, starts + size, 0), size)  # small groups: all pairs at once, by their distance
        at = np.arange(len(key))
        for step in range(1, FEW):
            i = at[at + step < few]
            if not len(i):
                break
            i = i[np.bitwise_count(codes[i] ^ codes[i + step]).sum(axis=1, dtype=np.int64) <= most]
            yield rows(key, node, codes, i[open_pairs(i, i + step)], step, False)
        for s, n in zip(starts[size > FEW], size[size > FEW]):
            for a, b, star in _candidates_in_group(codes[s : s + n], most, None if roots is None else roots[s : s + n]):
                keep = open_pairs(s + a, s + b)
                if keep.any():
                    yield rows(key, node, codes, s + a[keep], (b - a)[keep], star)

    def rows(key: np.ndarray, node: np.ndarray, codes: np.ndarray, i: np.ndarray, step: np.ndarray | int, star: bool) -> pa.RecordBatch:
        j = i + step
        if not star and len(i):
            known, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys, table = _sample_keys(codes[known], places), key[i] >> width
            first = np.concatenate([(keys[x] == keys[y]).argmax(axis=1) for x, y in zip(*(np.array_split(back[k * len(i) : (k + 1) * len(i)], len(i) // 100_000 + 1) for k in (0, 1)))])
            i, j = i[first == table], j[first == table]
        low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.full(len(i), star))], ["a", "b", "star"])

    more = "".join(f", {c} bigint" for c in extra)
    dealt = wide.select("node", "bits", *extra).transform(in_tasks, deal, f"key bigint, node bigint, bits binary{more}")
    return dealt.repartition("key").sortWithinPartitions("key").transform(in_tasks, link, "a bigint, b bigint, star boolean")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose ``sets`` (node, held: sorted hashes) have the Jaccard similarity, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                low, high = sorted((len(x), len(y)))
                if low and low / high >= similarity:
                    common = low + high - len(np.union1d(x, y))
                    good[k] = common / (low + high - common) >= similarity
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left, right = sets.toDF("a", "held_a"), sets.toDF("b", "held_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "held_a", "held_b").transform(in_tasks, run, "a bigint, b bigint")


def shared_hashes(sets: DataFrame) -> DataFrame:
    """(node, size, shared): the hashes of each set (node, held), and how many of them another of the sets has too.

    Hashes are counted with partial sums, so one that is in very many sets is a row from each task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, held in zip(batch.column(0), batch.column(1)):
                hashes = np.frombuffer(held.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), node.as_py(), np.int64))], ["hash", "node"])

    single = sets.select("node", "held").transform(in_tasks, each, "hash bigint, node bigint").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    single = single.groupBy("node").agg(F.count(F.lit(1)).alias("single"))
    size = F.shiftright(F.octet_length("held"), 3).cast("bigint")
    return sets.select("node", size.alias("size")).join(single, "node", "left").select("node", "size", (F.col("size") - F.coalesce("single", F.lit(0))).alias("shared"))


def similar_links(wide: DataFrame, sets_of, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) of nodes whose shingle sets have the similarity; they connect all candidates that do.

    ``sets_of`` turns nodes (node: bigint) to their sets, as ``confirmed`` reads them. The nearest
    candidates of dense groups are confirmed first; the candidates that these leave in different
    components follow pair by pair, so a chain of similar sets is found whole. A hash that only one
    set of a dense group has is in no intersection: sets with too many of these have no similar one,
    and pairs with too many are none, exactly, so the edited copies of one text are not compared with each other all over.
    """
    found = materialize(similar_candidates(wide, similarity), "candidates")
    pairs = found.select("a", "b").distinct()
    sets = materialize(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "sets")
    sure = materialize(confirmed(pairs, sets, similarity), "links")
    dense = found.where("star")
    if dense.isEmpty():
        return sure
    dense = dense.select(F.col("a").alias("node")).union(dense.select("b")).distinct()
    counted = materialize(shared_hashes(sets.join(dense, "node", "left_semi")), "shared-hashes")
    counted = counted.where((F.col("size") > 0) & (F.col("shared") / F.col("size") >= similarity))
    apart = wide.join(counted, "node").join(connected_components(sure), "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root"), "size", "shared")
    rest = materialize(similar_candidates(apart, similarity), "candidates")
    return sure.union(materialize(confirmed(rest.select("a", "b"), sets, similarity), "links"))


def _similar(docs: DataFrame, similarity: float, shingle: int, max_bits: int, bits_shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(prints, lowest): every row's id and node, and every node's component with its first row.

    A node is a distinct set of shingles, named by the hash of its sorted hashes.
    ``first`` is the row's (none, id, tag) that is least: null ids come last, and of rows with equal
    ids the one with the smallest hash of its text is first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            fp = np.fromiter((simhash(x, bits_shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
            sets = [shingle_set(x, shingle) for x in texts]
            node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp), pa.array([_wide(x) for x in sets], pa.binary()), pa.array(node)], ["id", "tag", "fp", "bits", "node"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(1)], pa.binary())], ["node", "held"])

    def sets_of(few: DataFrame) -> DataFrame:
        one = nodes.join(few, "node").select("node", "text_tag")
        texts = docs.select(F.xxhash64(text_col).alias("text_tag"), F.col(text_col).alias("text")).join(one, "text_tag")
        return texts.select("node", "text").transform(in_tasks, read, "node bigint, held binary").groupBy("node").agg(F.min("held").alias("held"))

    kind = docs.schema[id_col].dataType.simpleString()
    prints = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag")).transform(in_tasks, run, f"id {kind}, tag bigint, fp bigint, bits binary, node bigint")
    prints = materialize(prints, "fingerprints")
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("low"), F.min("bits").alias("bits"), F.min("tag").alias("text_tag"))
    known = prints.groupBy("fp").agg(F.min("node").alias("first"))
    same = prints.select("fp", "node").distinct().join(known, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    by_bits = hamming_links(known.select("fp"), max_bits)
    by_bits = by_bits.join(known.select(F.col("fp").alias("a"), F.col("first").alias("na")), "a").join(known.select(F.col("fp").alias("b"), F.col("first").alias("nb")), "b")
    links = similar_links(nodes.select("node", "bits"), sets_of, similarity).union(by_bits.select("na", "nb")).union(same.where("a <> b"))
    classes = nodes.select("node", "low").join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = materialize(classes.groupBy("root").agg(F.min("low").alias("first")), "lowest")
    return prints.select("id", "node"), classes.join(lowest, "root").select("node", "first")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bits: int = 2, bits_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row: groups by similar shingle sets or near 64-bit fingerprints.

    Documents link if the sets of their ``shingle``-word runs have the similarity, exactly, among
    the candidates that wide fingerprints propose, or as in ``near_duplicates``. Nulls, ties and repeats are treated as there.
    """
    prints, lowest = _similar(docs, similarity, shingle, max_bits, bits_shingle, id_col, text_col)
    return prints.join(lowest, "node").select("id", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bits: int = 2, bits_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each of ``similar_groups``: the row of the smallest id stays.

    A group without any id keeps one row of its own. Of several rows with the smallest id the one
    with the smallest hash of its text stays, and of repeats of it the first by a hash of the row.
    Rows with equal ids in different groups are judged each in its group. No column is changed.
    """
    _, lowest = _similar(docs, similarity, shingle, max_bits, bits_shingle, id_col, text_col)
    name, tag, place = fresh(docs, "name", "tag", "place")
    kept = lowest.select(F.xxhash64("first.id").alias(name), F.col("first.tag").alias(tag)).distinct()
    # The hashes are never null and are also the keys of the window, so whole rows are shuffled once.
    left = docs.withColumn(name, F.xxhash64(id_col)).withColumn(tag, F.xxhash64(text_col)).join(kept, [name, tag], "left_semi")
    plain = [f"`{f.name}`" for f in docs.schema if "map" not in f.dataType.simpleString()]
    order = Window.partitionBy(name, tag).orderBy(F.xxhash64(*plain))
    return left.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*(f"`{c}`" for c in docs.columns))
