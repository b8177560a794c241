"""Operator 5: n-gram Jaccard self-join by a pigeonhole over a partitioned universe.

Each document is the set of its distinct word shingles.  Sets are grouped into
size bands such that linked sets lie in the same or neighbouring bands.  For a
band, H is the largest symmetric difference of a linked pair, and the universe
of shingles is cut by hash into m segments with allowances.  By the pigeonhole a
linked pair agrees in some segment within its allowance: allowance 1 needs equal
segment subsets, allowance 2 equal ones after at most one deletion, so
one-deletion neighbourhoods are indexed too, and 0 leaves a segment out.

Allocation by cost, for each band, from the sizes of all sets:
* H + 1 + z segments of allowance 1: a linked pair has z + 1 equal segments, so a
  set with at most z empty segments leaves those out (an empty segment says
  nothing and would meet every other one); sets with more write them all;
* or half as many segments of allowance 2, all written.
Very common shingles form a segment of allowance 0: any fixed choice of them
keeps the pigeonhole, so they are found from batch counts.

Sets that share a segment key become candidates: as pairs where few share it, as a group
where many do.  A pair is dropped if its sketches differ in more bits than a linked
pair's sets may differ in shingles (a sketch holds, for each of its places, the parity of
the set's shingles there, so it never differs in more).  A long set's sketch has twice as
many places as the set has shingles, or it would be full and drop nothing; of two widths
the wider one is folded.  A group becomes a star around its
smallest set: sets close to that centre by their sketches are settled, and only sets that may
be linked with a settled one are tied to it (the distance of sketches obeys the triangle
inequality).  Where the sets of a group that are not settled stay in several parts, those
parts are compared with one another.  This keeps sets that met by chance, or by a passage
they share, from chaining, whether few or many met.  Connected candidates form a cluster
whose sets meet once (a large cluster by size bands, each with the next one, and in pairs
of blocks), where every pair is verified exactly through an inverted index.  Equal sets are folded before and counted, so copies
are never paired.

Shingles are compared by 64-bit hashes of their words, sets by 128-bit digests.

Defined results: null, empty and white-space texts have no shingles and link
with nothing; with fewer words than ``n`` the whole sequence is the one shingle;
a null id takes part but names no component; rows that share an id are rows of
their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import let_shuffles_go, partitions, rows_out, saved, small_batches, worker_cache
from foldwise.llm.components import components

#: Similarity as percent, and words of a shingle, unless a caller says otherwise.
PERCENT, WORDS = 80, 5
#: Shingles of the sets that one task verifies together (a block of a cluster).
BLOCK = 1 << 21
#: Bytes of text that are shingled at a time.
TEXTS = 2 << 20
#: Key rows are dealt by this many hash buckets for each shuffle partition.
BUCKETS = 16
#: Words whose hash a worker remembers, their longest, and sets that a task knows it has indexed.
MEMO, MEMO_BYTES = 150_000, 64
#: Sets of a key that are paired with one another; more of them form a group.
PAIRED = 8
#: Places of a sketch, in words of 64 bits, for sets of no more shingles than that.
SKETCH = 16
#: Common shingles: in this share of a batch's sets, and at most so many.
COMMON_SHARE, COMMON = 0.02, 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser: fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; remembers words' hashes up to a bound."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _hash(self, word: bytes) -> int:
        h = self.known.get(word)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            if len(word) <= MEMO_BYTES:
                if len(self.known) >= MEMO:
                    self.known.clear()
                self.known[word] = h
        return h

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ascending distinct shingle hashes."""
        # lowered before the cast: a cast slice keeps its offset, which the kernel overlooks
        low = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        cut = pc.ascii_split_whitespace(low)
        at = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        real = np.fromiter(map(bool, words), bool, len(words))          # leading or trailing space makes an empty word
        which = coded.indices.to_numpy()
        keep = real[which] if len(which) else np.zeros(0, bool)
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        flat = h[which[keep]] if len(which) else np.zeros(0, np.uint64)
        n = self.n
        starts = max(0, len(flat) - n + 1)                              # a batch may hold fewer than n words
        rolled = np.full(starts, n, np.uint64)
        for k in range(n):
            rolled = mix(rolled + flat[k:starts + k])
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(rolled[a:b - n + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    one = mix(one + flat[k])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch_words(n: int) -> int:
    """Words of the sketch of a set of n shingles: SKETCH, or a power of two for at least 2 n places."""
    return SKETCH if n <= 64 * SKETCH else 1 << (2 * n - 1).bit_length() - 6


def sketch(s: np.ndarray) -> list[int]:
    """The parity of the set's shingles at each of its places."""
    places = 64 * sketch_words(len(s))
    odd = np.bincount((s % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one in each row, as if made with so many words (a divisor of theirs)."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)      # of a signed number it counts the magnitude's bits


def settles(bits: np.ndarray, centre: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set settles at a centre of so many shingles whose sketch differs in ``bits``."""
    return 3 * percent * bits <= 2 * (100 - percent) * centre


def reaches(bits: np.ndarray, size: np.ndarray, centre: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of so many shingles may be linked with one that settled at the centre: it differs
    from that one in at most size * (100 - percent) / percent shingles, and that one from the centre as above."""
    return 3 * percent * bits <= (100 - percent) * (3 * size + 2 * centre)


def ties_of(names: list[int], part: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect every two sets of a group that may be linked; ``part`` tells which are connected already.
    Sets outside the largest part are compared with those of all other parts."""
    words = min(map(len, sketches))
    m = np.concatenate([folded(s[None], words) for s in sketches])
    part, count = np.unique(part, return_inverse=True, return_counts=True)[1:]
    order = np.argsort(part != count.argmax(), kind="stable")
    m, part, size, out = m[order], part[order], size[order], []
    for i in range(count.max(), len(order)):
        other = np.flatnonzero(part[:i] != part[i])
        hit = other[bits_apart(m[other], m[i]) * (100 + percent) <= (size[other] + size[i]) * (100 - percent)]
        for p, j in zip(*np.unique(part[hit], return_index=True)):
            out.append((names[order[i]], names[order[hit[j]]]))
            part[part == p] = part[i]
    return out


# ---- bands and allowances ----

def bands(largest: int, percent: int) -> list[int]:
    """Lower ends of the size bands up to ``largest``: a set links into its own or the next band only."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    return low


def difference(top: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set has at most ``top`` shingles."""
    both = top + top * 100 // percent
    return both * (100 - percent) // (100 + percent)


def allowances(low: int, top: int, sets: int, percent: int) -> tuple[int, int, int]:
    """(segments of allowance 1, segments of allowance 2, empty ones that may be
    left out) of the least cost for a band of so many sets.

    Cost: the keys that all sets write, plus the pairs of unlike sets that meet by
    chance in empty segments (the number of empty ones is taken as Poisson)."""
    need = difference(top, percent) + 1

    def cost(ones: int, twos: int, spare: int) -> float:
        m = ones + twos
        size = low / m
        if twos:
            return sets * twos * (1 + size) + 4 * m * (sets * math.exp(-size) * (1 + size)) ** 2
        mean = m * math.exp(-size)
        term = total = math.exp(-mean)
        for k in range(1, spare + 1):
            term *= mean / k
            total += term
        wrote = max(0.0, 1 - total) if spare else 1.0
        return sets * m + 4 * m * (sets * wrote * min(1.0, max(mean, spare + 1) / m)) ** 2

    options = [(need + z, 0, z) for z in {0, 1, 2, 4, *(need * k // 16 for k in range(1, 9))}] + [(0, (need + 1) // 2, 0)]
    return min(sorted(options), key=lambda x: cost(*x))


def keys_of(sets: list[np.ndarray], plan: list[tuple[int, ...]], percent: int, common: np.ndarray) -> list[np.ndarray]:
    """The segment keys of each set in its own band and in the band below."""
    lows = np.array([p[0] for p in plan])
    out = []
    for s in sets:
        if not len(s):
            out.append(np.zeros(0, np.uint64))
            continue
        own = int(np.searchsorted(lows, len(s), "right")) - 1
        rare = s
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            rare = s[common[at] != s]
        found = []
        for band in (own, own - 1):
            if band < 0 or band < own and plan[band][1] * 100 < percent * len(s):
                continue                       # no set of the band below is large enough
            _, _, ones, twos, spare = plan[band]
            m = ones + twos
            token = mix(rare + np.uint64(band + 1))
            seg = ((token >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            value = mix(token)
            total = np.zeros(m, np.uint64)
            np.add.at(total, seg, value)
            salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
            keys = mix(total + salt)
            if twos:                           # one deletion is allowed
                found.append(mix(total[seg] - value + salt[seg]))
            elif spare:
                empty = np.bincount(seg, minlength=m) == 0
                if empty.sum() <= spare:
                    keys = keys[~empty]
            found.append(keys)
        out.append(np.unique(np.concatenate(found)))
    return out


# ---- Spark ----

@worker_cache
def _shingler(n: int) -> Shingler:
    return Shingler(n)


def sizes(docs: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """Id, set size and set digest (null for an empty set) of every row; the first
    row of a batch also names the shingles that are common in that batch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.string()), ("common", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", TEXTS):
            sets = _shingler(n).sets(b.column("text"))
            common: list = [None] * len(sets)
            if sets:
                token, count = np.unique(np.concatenate(sets), return_counts=True)
                common[0] = token[count >= max(8, COMMON_SHARE * len(sets))].view(np.int64).tolist()
            yield rows_out(schema, b.column("doc_id"), [len(s) for s in sets], [digest(s).hex() if len(s) else None for s in sets], common,
                           [sketch(s) if len(s) else None for s in sets])

    return _rows(docs, id_col, text).mapInArrow(run, "doc_id bigint, n_shingles bigint, `set` string, common array<bigint>, sketch array<bigint>")


def common_shingles(counted: DataFrame) -> np.ndarray:
    """The shingles that were common in most batches, ascending (at most COMMON)."""
    top = (counted.where("common is not null").select(F.explode("common").alias("c")).groupBy("c").count()
           .orderBy(F.desc("count"), "c").limit(COMMON).collect())
    return np.sort(np.array([r.c for r in top], np.int64).view(np.uint64))


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def allocation(counted: DataFrame, percent: int) -> list[tuple[int, ...]]:
    """(lowest size, highest size, ones, twos, spare) of each band, from the sizes of all
    different sets.  The driver gets one number for each band that is in use."""
    different = counted.where("n_shingles > 0").select("set", "n_shingles").distinct()
    top = different.agg(F.max("n_shingles")).first()[0]
    if top is None:
        return []
    lows = bands(top, percent)
    edges = F.array(*map(F.lit, lows))
    band = F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1
    hist = different.groupBy(F.col("n_shingles").alias("n")).count().groupBy(band.alias("b")).agg(F.sum("count").alias("sets")).collect()
    sets = {r.b: r.sets for r in hist}
    return [(a, b - 1, *allowances(a, b - 1, sets.get(i, 0) + sets.get(i + 1, 0), percent)) for i, (a, b) in enumerate(zip(lows, lows[1:]))]


def candidates(docs: DataFrame, plan: list[tuple[int, ...]], common: np.ndarray, n: int, percent: int, id_col: str, text: str) -> DataFrame:
    """Edges (u, v) between sets that share a segment key: all pairs of at most PAIRED
    sets, else a star of the group's sets and its smallest one (``group`` names the list of
    its sets, and is null for a pair).  Sets go by the first 64 bits of their digest and keys
    by 32 bits in their bucket, as more candidates do no harm."""
    spark = docs.sparkSession
    plan_and_common = spark.sparkContext.broadcast((plan, common))
    buckets = BUCKETS * partitions(spark)
    packed = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("group", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in small_batches(batches, "text", TEXTS):
            fresh, names = [], []
            for s in _shingler(n).sets(b.column("text")):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    fresh.append(s)
                    names.append(int.from_bytes(d[:8], "big", signed=True))
            if len(seen) > MEMO:
                seen.clear()
            lists = keys_of(fresh, plan_and_common.value[0], percent, plan_and_common.value[1])
            if not lists:
                continue
            keys = np.concatenate(lists)
            sets = np.repeat(np.array(names, np.int64), [len(x) for x in lists])
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, sets, bucket = (keys[order] >> np.uint64(32)).astype(np.uint32), sets[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*at[1:].tolist(), len(keys)]
            yield rows_out(packed, bucket[at], [keys[i:j].tobytes() for i, j in zip(at, ends)],
                           [sets[i:j].tobytes() for i, j in zip(at, ends)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def stars() -> Iterator[pa.RecordBatch]:
            k, s = np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(sets), np.int64)
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            k, s = k[new], s[new]                                   # a set once for each key
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(first, len(k)))
            size, place = np.repeat(count, count), np.arange(len(k)) - np.repeat(first, count)
            found = [np.zeros((0, 2), np.int64)]
            for back in range(1, PAIRED):                           # with each earlier set of a small group
                at = np.flatnonzero((size <= PAIRED) & (place >= back))
                found.append(np.stack([s[at], s[at - back]], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                yield rows_out(edge, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64()))
            at = np.flatnonzero((size > PAIRED) & (place > 0))
            if len(at):                                             # equal groups get one name
                group = np.repeat(mix(np.add.reduceat(mix(s.view(np.uint64)), first)).view(np.int64), count)
                rows = np.unique(np.stack([s[at], s[at - place[at]], group[at]], 1), axis=0)
                yield rows_out(edge, *(pa.array(rows[:, i].copy()) for i in range(3)))

        for b in batches:
            for bucket, k, s in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    if keys:
                        yield from stars()
                    now, keys, sets = bucket, [], []
                keys.append(k)
                sets.append(s)
        if keys:
            yield from stars()

    return (_rows(docs, id_col, text).mapInArrow(index, "bucket int, keys binary, sets binary")
            .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "u bigint, v bigint, `group` bigint"))


def plausible(edges: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect all sets that may be linked by their sizes and sketches: the pairs that
    may, the stars of the groups around their smallest sets (mostly the same one in many groups), and
    ties between the parts in which the sets of a group that have not settled there are left."""
    name = F.conv(F.substring("set", 1, 16), 16, -10).cast("bigint")
    # sets that share the 64 bits of a name are told apart by nothing here: they may be linked with any other
    known = reps.groupBy(name.alias("name")).agg(F.count("*").alias("k"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sides = [known.select(F.col("name").alias(c), (F.col("k") > 1).alias(f"{c}k"), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s")) for c in "uv"]
    judged_as = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("pair", pa.bool_()), ("may", pa.bool_()), ("settled", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, un, vn, uk, vk = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "un", "vn", "uk", "vk"))
            bits, near = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            data = [(x.values.to_numpy(), x.offsets.to_numpy()[:-1]) for x in (b.column("us"), b.column("vs"))]
            # a set linked with u has a sketch of ``least`` words at least
            words = np.array([(sketch_words(x), sketch_words(y), sketch_words(x * percent // 100)) for x, y in zip(un.tolist(), vn.tolist())]).reshape(-1, 3)
            for own, other, least in np.unique(words, axis=0).tolist():
                at = np.flatnonzero((words == (own, other, least)).all(axis=1))
                two = [values[start[at][:, None] + np.arange(w)] for (values, start), w in zip(data, (own, other))]
                bits[at] = bits_apart(*(folded(x, min(own, other)) for x in two))
                near[at] = bits_apart(*(folded(x, min(least, other)) for x in two))
            may = np.where(pair, bits * (100 + percent) <= (un + vn) * (100 - percent), reaches(near, un, vn, percent)) | uk | vk
            yield rows_out(judged_as, b.column("u"), b.column("v"), pair, may, ~pair & (settles(bits, vn, percent) | vk))

    met = edges.select("u", "v", F.col("group").isNull().alias("pair")).distinct()
    judged = saved(met.join(sides[0], "u").join(sides[1], "v").mapInArrow(judge, "u bigint, v bigint, pair boolean, may boolean, settled boolean"))
    joined = components(judged.where("may").select("u", "v"))
    rest = edges.where("group is not null").distinct().join(judged.where("settled").select("u", "v"), ["u", "v"], "left_anti").select("group", "u")
    rest = saved(rest.join(joined, F.col("u") == F.col("node"), "left").select("group", "u", F.coalesce("root", "u").alias("part")))
    apart = rest.groupBy("group").agg(F.count("*").alias("sets"), F.sum(F.xxhash64("u").cast("decimal(38)")).alias("list"),
                                      F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    groups = apart.groupBy("sets", "list").agg(F.min("group").alias("group")).select("group")      # of equal ones the first
    tie = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def tied() -> Iterator[pa.RecordBatch]:
            names, parts, any_other, size, sketches = zip(*rows)
            found = [(x, names[0]) for x in names[1:]] if any(any_other) else ties_of(names, np.array(parts), np.array(size), sketches, percent)
            if found:
                yield rows_out(tie, *zip(*found))

        for b in batches:
            values, at = b.column("us").values.to_numpy(), b.column("us").offsets.to_numpy().tolist()
            for i, (group, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "u", "part", "uk", "un")))):
                if group != now:
                    if rows:
                        yield from tied()
                    now, rows = group, []
                rows.append((*row, values[at[i]:at[i + 1]].copy()))
        if rows:
            yield from tied()

    ties = (rest.join(groups, "group").join(sides[0], "u").select("group", "u", "part", "uk", "un", "us").repartition(partitions(edges.sparkSession), "group")
            .sortWithinPartitions("group", "u").mapInArrow(compare, "u bigint, v bigint"))
    return joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(ties)


def linked_sets(docs: DataFrame, reps: DataFrame, clusters: DataFrame, lows: list[int], n: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Verified links inside the clusters: stars (u, v) of set digests, and for each
    set the number of documents it links with in other sets.

    In a cluster of several blocks a set goes to the unit of its size band (``lows``),
    where it is at home, and to that of the band below, so each pair that may be linked
    meets in one unit with at least one of the two at home."""
    spark = docs.sparkSession
    chosen = reps.join(clusters, F.conv(F.substring("set", 1, 16), 16, -10).cast("bigint") == F.col("node")).select(
        F.col("rep").alias("_id"), F.col("set").alias("_set"), "copies", F.col("root").alias("cluster"), F.col("n_shingles").alias("n"))
    def with_blocks(sets: DataFrame) -> DataFrame:
        total = sets.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        return sets.join(total, "cluster")

    band = F.size(F.filter(F.array(*map(F.lit, lows)), lambda e: e <= F.col("n"))) - 1
    chosen = with_blocks(chosen).withColumn("band", band)
    chosen = chosen.withColumn("unit", F.explode(F.when(F.col("blocks") > 1, F.array("band", F.col("band") - 1)).otherwise(F.array(F.lit(-2)))))
    chosen = chosen.withColumn("home", (F.col("unit") == F.col("band")) | (F.col("unit") == -2)).withColumn("cluster", F.xxhash64("cluster", "unit"))
    chosen = with_blocks(chosen.drop("blocks")).withColumn("block", F.pmod(F.xxhash64("_set"), F.col("blocks")).cast("int"))
    places = chosen.groupBy("_id", "_set", "copies").agg(F.collect_list(F.struct("cluster", "blocks", "block", "home")).alias("places"))
    rows = _rows(docs, id_col, text).join(places, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "_set", "copies", "places")
    made = pa.schema([("cluster", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("block", pa.int32()), ("home", pa.bool_()), ("set", pa.string()),
                      ("copies", pa.int64()), ("shingles", pa.binary())])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", TEXTS):
            out = []
            for s, name, copies, places in zip(_shingler(n).sets(b.column("text")), *(c.to_pylist() for c in b.columns[1:])):
                if digest(s).hex() == name:      # rows that share an id may have other texts
                    data = s.tobytes()
                    out.extend((p["cluster"], min(p["block"], o), max(p["block"], o), p["block"], p["home"], name, copies, data)
                               for p in places for o in range(p["blocks"]))
            if out:
                yield rows_out(made, *zip(*out))

    stars = pa.schema([("u", pa.string()), ("v", pa.string()), ("links", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit = None, {}
        for b in small_batches(batches, "shingles"):
            for cluster, x, y, block, home, name, copies, data in zip(*(c.to_pylist() for c in b.columns)):
                if (cluster, x, y) != now:
                    if unit and (found := links_of(unit, now[1] != now[2], percent)):
                        yield rows_out(stars, *zip(*found))
                    now, unit = (cluster, x, y), {}
                unit[name] = (np.frombuffer(data, np.uint64), copies, block, home)
        if unit and (found := links_of(unit, now[1] != now[2], percent)):
            yield rows_out(stars, *zip(*found))

    out = saved(rows.mapInArrow(shingles, "cluster bigint, a int, b int, block int, home boolean, `set` string, copies bigint, shingles binary")
                .repartition(partitions(spark), "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
                .mapInArrow(verify, "u string, v string, links bigint"))
    return out.where("u != v").select("u", "v"), out.where("links > 0").groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("links"))


def links_of(unit: dict[str, tuple[np.ndarray, int, int, bool]], across: bool, percent: int) -> list[tuple[str, str, int]]:
    """Verifies all pairs of a unit with one at home there (only pairs of different blocks if ``across``):
    (set, smallest set that it reaches here, documents it links with) of each linked set."""
    names = sorted(unit, key=lambda x: (len(unit[x][0]), x))
    if len(names) < 2:
        return []
    size = np.array([len(unit[x][0]) for x in names])
    copies = np.array([unit[x][1] for x in names])
    block = np.array([unit[x][2] for x in names])
    home = np.array([unit[x][3] for x in names])
    token, df = np.unique(np.concatenate([unit[x][0] for x in names]), return_inverse=True, return_counts=True)[1:]
    at = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(names)), size)[order]              # postings, by token, sets ascending
    begin = np.cumsum(df) - df
    root, links = list(range(len(names))), np.zeros(len(names), np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for s in range(1, len(names)):
        own = token[at[s]:at[s + 1]]
        own = own[df[own] > 1]
        count = df[own]
        if not len(own):
            continue
        where = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[where], minlength=s)[:s]              # shared shingles with each smaller set
        hit = np.flatnonzero(100 * both >= percent * (size[:s] + size[s] - both))
        hit = hit[(both[hit] > 0) & (home[hit] | home[s])]
        if across:
            hit = hit[block[hit] != block[s]]
        if len(hit):
            links[s] += copies[hit].sum()
            links[hit] += copies[s]
            for r in hit.tolist():
                a, b = find(r), find(s)
                root[max(a, b)] = min(a, b)
    return [(names[i], names[find(i)], int(links[i])) for i in np.flatnonzero(links).tolist()]


def _found(docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """The rows of ``join`` with their set's digest (``set``) and the digest of the
    set that stands for their component (``keeper``: of the smallest id, the smallest)."""
    spark = docs.sparkSession
    counted = saved(sizes(docs, n, id_col, text))
    reps = counted.where("set is not null").groupBy("set").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    plan = allocation(counted, percent)
    if plan:
        met = saved(candidates(docs, plan, common_shingles(counted), n, percent, id_col, text))
        let_shuffles_go(spark)
        clusters = components(plausible(met, reps, percent))
        let_shuffles_go(spark)
        edges, links = linked_sets(docs, reps, clusters, [p[0] for p in plan], n, percent, id_col, text)
        let_shuffles_go(spark)
        roots = components(edges)
    else:
        roots = spark.createDataFrame([], "node string, root string")
        links = spark.createDataFrame([], "`set` string, links bigint")
    classes = reps.join(roots, reps["set"] == roots["node"], "left").select("set", "rep", "copies", F.coalesce("root", "set").alias("root"))
    least = classes.groupBy("root").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "set"))).alias("least"))
    named = classes.join(least, "root").join(links, "set", "left").select(
        F.col("set").alias("_set"), F.col("least.rep").alias("component"), F.col("least.set").alias("keeper"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = counted.join(named, F.col("set") == F.col("_set"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                      F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "set", "keeper")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: set size, the smallest id of its component
    (``component_id``) and the number of documents it links with (``n_links``)."""
    return _found(docs, id_col, text, n, percent).drop("set", "keeper")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id
    (of its sets, the one with the smallest digest).  Rows without an id or without
    shingles are kept; rows of one id and one set are one document."""
    stays = F.col("set").isNull() | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("set") == F.col("keeper"))
    found = saved(_found(docs, id_col, text, n, percent).where("doc_id is not null").select("doc_id", "set", (~stays).alias("gone")).distinct())
    ids = saved(found.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("gone").alias("any"), F.bool_and("gone").alias("all")).where("any"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    row_id, row_text = (names[docs.columns.index(c)] for c in (id_col, text))
    rows = docs.toDF(*names)
    kept = rows.join(ids, F.col(row_id) == F.col("_gone"), "left_anti")
    # ids of rows that go and of rows that stay: their rows are told apart by their sets
    mixed = saved(ids.where("not all").select("_gone"))
    let_shuffles_go(docs.sparkSession)
    if mixed.isEmpty():
        return kept.toDF(*docs.columns)
    pairs = found.where("gone").join(mixed, F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("set").alias("_gone_set"))
    unsure = rows.join(mixed, F.col(row_id) == F.col("_gone"), "left_semi").withColumn("_set", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, row_text, TEXTS):
            sets = [digest(s).hex() if len(s) else None for s in _shingler(n).sets(b.column(row_text))]
            yield b.set_column(b.num_columns - 1, "_set", pa.array(sets, pa.string()))

    told = unsure.mapInArrow(run, unsure.schema).join(pairs, (F.col(row_id) == F.col("_id")) & (F.col("_set") == F.col("_gone_set")), "left_anti")
    return kept.unionByName(told.drop("_set")).toDF(*docs.columns)
