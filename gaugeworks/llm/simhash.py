"""SimHash near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint form a ring of three segments. If two fingerprints differ in RADIUS = 2 bits at most, then from some segment on
every chain of consecutive segments stays within its share of the budget: the first segment differs in 0 bits, the first two in 1 at most,
all three in 2. Distinct fingerprints meet in buckets of (segment, value); a pair is a candidate if its chain from that segment keeps
within these budgets, and a link after the full Hamming check.

The chains are looked for within the bucket; of the pairs that pass, those that tie the bucket together become links, so that a crowd of near
copies gives no more links than it has members. Three segments of 21 bits or more keep the buckets of distinct texts below BUCKET members up to
2^21 * BUCKET, some four billion fingerprints. A bucket beyond it, a crowd of near copies, follows the chain to its end by keys: each of its
fingerprints gets 65 hubs, itself and its one-bit neighbours. Two fingerprints differ in at most 2 bits exactly if they share a hub, and a hub
has at most 65 members, so tying each member to the hub's least member gives the same components at a linear cost.

A null or empty text has fingerprint 0, linked like any other. Components carry the smallest id; null ids count last. Repeated rows share
their component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scope, Written, semi_join, slices, text_buffer
from .components import components

RADIUS = 2
#: Lowest bit and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET = 2048
#: Members up to which all pairs of a bucket are held against each other at once.
FEW = 64
SEED = 42
#: Rows of one fingerprint from which it counts as hot, and how many such fingerprints there can be.
LEAST_HOT, HOT = 200, 10_000
_CHUNK = 1 << 15


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Of a text in UTF-8: words of the lower-cased text, shingles, XXH64; bits set in over half the hashes, as an unsigned number."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest, n, counts = xxhash.xxh64_digest, len(starts), np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        found = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + _CHUNK], stops[lo : lo + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, out_col: str = "__fp") -> DataFrame:
    """`docs` without its text, with each text's fingerprint as a signed long."""
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, lengths = text_buffer(batch.column(at))
            view = memoryview(data)
            found = np.fromiter((fingerprint(bytes(view[s : s + n]), shingle) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)), np.uint64, len(starts))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(found.view(np.int64))], [*(f.name for f in fields), out_col])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.LongType())]))


def _segment(bits: np.ndarray, k: int) -> np.ndarray:
    low, width = SEGMENTS[k % len(SEGMENTS)]
    return (bits >> np.uint64(low)) & np.uint64((1 << width) - 1)


def _chained(differ: np.ndarray, seg: int) -> np.ndarray:
    """Which differences of equal first segments keep the chain's budgets: 1 bit in two of the three segments, RADIUS in all."""
    near = np.bitwise_count(_segment(differ, seg + 1)) <= RADIUS * 2 // 3
    return near & (np.bitwise_count(differ) <= RADIUS)


def _tied(x: np.ndarray, seg: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that tie the members of a bucket together as all its near pairs would."""
    if len(x) <= FEW:
        i, j = np.triu_indices(len(x), 1)
        near = _chained(x[i] ^ x[j], seg)
        return [x[i[near]]], [x[j[near]]]
    a_out, b_out, left = [], [], x
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front:
            y = front.pop()
            near = _chained(left ^ y, seg)
            if near.any():
                found, left = left[near], left[~near]
                a_out.append(np.full(len(found), y))
                b_out.append(found)
                front.extend(found)
    return a_out, b_out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (segment, fps) of BUCKET fingerprints at most to links: the chain filter, then the Hamming check."""
    for batch in slices(batches):
        a_out, b_out = [], []
        for k, seg in enumerate(batch.column("seg").to_pylist()):
            a, b = _tied(batch.column("fps")[k].values.to_numpy(zero_copy_only=False).view(np.uint64), seg)
            a_out += a
            b_out += b
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64)) for c in (a_out, b_out)], ["a", "b"])


def links(fps: DataFrame, scope: Scope) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that have the same components as all pairs within RADIUS."""
    keyed = fps.select("fp", F.posexplode(F.array(*(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for low, width in SEGMENTS))).alias("seg", "val"))
    counts = keyed.groupBy("seg", "val").count().where("count > 1").select(F.col("seg").alias("s"), F.col("val").alias("v"), "count")
    met = scope.write(keyed.join(counts, (F.col("seg") == F.col("s")) & (F.col("val") == F.col("v"))).select("seg", "val", "fp", "count"), "simhash-buckets")
    small = met.where(F.col("count") <= BUCKET).groupBy("seg", "val").agg(F.collect_list("fp").alias("fps")).select("seg", "fps")
    pairs = small.mapInArrow(_bucket_links, "a long, b long")
    crowd = met.where(F.col("count") > BUCKET).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    hubs = crowd.select("fp", F.explode(flips).alias("hub")).groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    tied = hubs.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b").distinct()
    return pairs.unionByName(tied)


def group(prints: DataFrame, id_col: str, fp_col: str = "__fp") -> DataFrame:
    """(id, fp) rows with `component`, the least id of all rows whose fingerprint is reachable. Ids may be structs; nulls are ignored."""
    scope = Scope()
    fps = scope.write(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    roots = scope.write(components(links(fps.select("fp"), scope), scope), "simhash-roots")
    rooted = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component")).select(F.col("root").alias("r"), "component")
    linked = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component")
    classes = Written(fps.join(linked, F.col("fp") == F.col("f"), "left").select("fp", "n", F.coalesce("component", "first").alias("component")), "simhash-classes").df
    scope.drop()
    # fingerprints of many rows, HOT at most by their least share of all rows, are broadcast; the rows of the others are dealt out evenly
    total = classes.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_HOT, total // HOT)
    hot = classes.where(F.col("n") > least).select(F.col("fp").alias("f"), "component")
    hot_fps = F.broadcast(hot.select(F.col("f").alias("g")))
    dealt = prints.join(hot_fps, F.col(fp_col) == F.col("g"), "left_anti").join(classes.where(F.col("n") <= least).select(F.col("fp").alias("f"), "component"), F.col(fp_col) == F.col("f"))
    return dealt.unionByName(prints.join(F.broadcast(hot), F.col(fp_col) == F.col("f"))).drop("f")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    prints = Written(fingerprints(docs.select(id_col, text_col), text_col, shingle), "simhash-prints", slim=True).df
    return group(prints, id_col).select(id_col, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Near copies at a similarity of 0.8 or more: an exact join of shingle sets, see keep_one.

#: Near copies share SIMILAR[0] / SIMILAR[1] of the union of their shingle sets at least.
SIMILAR = (4, 5)
#: Members of a crowded bucket that meet at once; larger ones meet block against block.
CROWD = 500
#: One text of SAMPLE is looked at for common shingles; those seen COMMON times or more come last in the order of shingles, MOST_COMMON at most.
#: The order decides how many texts meet, not which pairs are found.
SAMPLE, COMMON, MOST_COMMON = 32, 4, 200_000
#: Bits of a sketch of a set: of each residue of the hashes, whether their number is odd. Sketches differ in no more bits than sets in shingles.
#: A sketch has LEAST_SKETCH bits, or twice as many as its set has shingles, in powers of two; folding its halves gives the shorter ones.
LEAST_SKETCH, MOST_SKETCH = 512, 1 << 17


def shingle_hashes(raw: bytes, shingle: int = 5) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, in order; a text of fewer words is one shingle, one without words has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n)


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingles, as a signed number."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[lo : lo + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def shingle_set(raw: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(raw, shingle))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, so many that two sets of SIMILAR share one of them: rare ones by hash, then `common` by rank."""
    part, whole = SIMILAR
    n = len(hashes)
    take = n - -(-part * n // whole) + 1 if n else 0
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        last = common[at] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last][np.argsort(rank[at[last]])]])
    return hashes[:take]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


#: Buckets unpacked at once, of CROWD members or fewer each.
BUCKETS = 32
#: Texts looked up by broadcast (16 bytes each); of more, the texts are dealt out by a shuffle.
BROADCAST_TEXTS = 1_000_000


def sketch(hashes: np.ndarray) -> bytes:
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else LEAST_SKETCH
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, size: int = LEAST_SKETCH // 8) -> np.ndarray:
    """The sketch of fewer bits, as words."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _allowed(n_a, n_b, differ):
    """False only for pairs whose sketches differ in more bits than SIMILAR sets can in shingles."""
    part, whole = SIMILAR
    return (part + whole) * differ <= (whole - part) * (n_a + n_b)


def _close(n_a, short_a: np.ndarray, n_b, short_b: np.ndarray) -> np.ndarray:
    return _allowed(n_a, n_b, np.bitwise_count(short_a ^ short_b).sum(axis=1, dtype=np.int64))


def _differ(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64))


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LEAST_SKETCH // 64)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    data, starts, lengths = text_buffer(batch.column(name))
    view = memoryview(data)
    return (bytes(view[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common shingles of a sample (who, text), sorted, and the rank of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, shingle) for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["shingle"])

    seen = texts.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    hashes = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(rows), 0, -1)[order]


def _set_prints(texts: DataFrame, shingle: int) -> DataFrame:
    """(who, text) to (who, fingerprint, digest of the shingle set, its size, its sketch, whole and short, its prefix)."""
    common, rank = _common(texts.where(F.pmod(F.col("who.k.a"), F.lit(SAMPLE)) == 0), shingle)
    who = next(f for f in texts.schema.fields if f.name == "who")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(t, shingle) for t in _texts(batch, "text")]
            prints, sets = pa.array([print_of(x) for x in hashes], pa.int64()), [np.unique(x) for x in hashes]
            sketches = [sketch(x) for x in sets]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("who"), prints, digests, pa.array([len(x) for x in sets], pa.int32()), pa.array(sketches, pa.binary()), pa.array([folded(x).tobytes() for x in sketches], pa.binary()), _lists([prefix(x, common, rank) for x in sets])], ["who", "fp", "digest", "n", "sketch", "short", "prefix"])

    return texts.mapInArrow(run, T.StructType([who, T.StructField("fp", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("short", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]))


def _may_match(n_a, at_a, n_b, at_b):
    """False only for pairs that cannot be SIMILAR if the shingle at these places is their first common one."""
    part, whole = SIMILAR
    return (whole * np.minimum(n_a, n_b) >= part * np.maximum(n_a, n_b)) & ((part + whole) * np.minimum(n_a - at_a, n_b - at_b) >= part * (n_a + n_b))


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    column = batch.column("members")
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, kind = column.flatten(), column.type.value_type
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), {kind.field(k).name: _words(flat.field(k)) if kind.field(k).name == "short" else flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(kind.num_fields)}


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["a", "b"])


def _star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's members with its first one."""
    for batch in slices(batches, BUCKETS):
        offsets, m = _members(batch)
        bucket = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((m["id"], m["o"], bucket))
        lead, this = order[offsets[:-1]][bucket], order
        fit = _may_match(m["n"][lead], m["pos"][lead], m["n"][this], m["pos"][this]) & (m["id"][lead] != m["id"][this])
        yield _pairs([m["id"][lead[fit]]], [m["id"][this[fit]]])


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All close pairs of members from different components; of two blocks, those between the blocks."""
    for batch in slices(batches, BUCKETS):
        offsets, m = _members(batch)
        block_i, block_j = (batch.column(x).to_numpy(zero_copy_only=False) for x in "ij")
        one_block = block_i == block_j
        a_out, b_out, held = [], [], 0
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            rows = np.arange(lo, hi)
            left, right = (rows, rows) if one_block[k] else (rows[m["block"][lo:hi] == block_i[k]], rows[m["block"][lo:hi] != block_i[k]])
            x, y = left[:, None], right[None, :]
            fit = (m["root"][x] != m["root"][y]) & _may_match(m["n"][x], m["pos"][x], m["n"][y], m["pos"][y])
            if one_block[k]:
                fit = np.triu(fit, 1)
            p, q = np.nonzero(fit)
            for at in range(0, len(p), _CHUNK):
                a, b = left[p[at : at + _CHUNK]], right[q[at : at + _CHUNK]]
                near = _close(m["n"][a], m["short"][a], m["n"][b], m["short"][b])
                a_out.append(m["id"][a[near]])
                b_out.append(m["id"][b[near]])
                held += len(a_out[-1])
            if held > 1 << 20:
                yield _pairs(a_out, b_out)
                a_out, b_out, held = [], [], 0
        yield _pairs(a_out, b_out)


def _screened(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Of candidates (a, b), those whose sketches are close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_a, n_b = (batch.column(x).to_numpy().astype(np.int64) for x in ("n_a", "n_b"))
            differ = np.array([_differ(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_allowed(n_a, n_b, differ), pa.bool_()))

    first = distinct.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    second = distinct.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    return pairs.distinct().join(first, "a").join(second, "b").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int, scope: Scope) -> DataFrame:
    """The shingle sets (id, hashes) of the wanted (id, k): of the text whose row has the key k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([shingle_set(t, shingle) for t in _texts(batch, "text")])], ["id", "hashes"])

    found = scope.write(wanted, "near-wanted")
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    rows = texts.select(F.col("who.k").alias("k"), "text").join(found, "k").dropDuplicates(["k"]).select("id", "text")
    return rows.mapInArrow(run, "id long, hashes array<long>")


def _verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, shingle: int, scope: Scope) -> DataFrame:
    """Of candidates (a, b), those whose sets are SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            halves = []
            for name in ("x", "y"):
                column = batch.column(name)
                halves.append((column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)))
            (x, xo), (y, yo) = halves
            fit = pa.array([similar(x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]) for k in range(batch.num_rows)], pa.bool_())
            yield batch.select(["a", "b"]).filter(fit)

    own = Scope()
    candidates = own.write(pairs.distinct(), "near-candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = own.write(_sets(texts, distinct.join(wanted, "id", "left_semi").select("id", "k"), shingle, own), "near-sets")
    first, second = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    found = scope.write(candidates.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")
    own.drop()
    return found


def _ring_pairs(distinct: DataFrame, scope: Scope) -> DataFrame:
    """Candidates (a, b) by the ring: the first sets of linked fingerprints, and the sets of one fingerprint with its first one."""
    first = scope.write(distinct.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "near-fingerprints")
    ids = lambda k: first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}"))
    linked = links(first.select("fp"), scope).join(ids("a"), "a").join(ids("b"), "b").select("first_a", "first_b")
    shared = semi_join(distinct.select("id", "fp"), first.where("n > 1"), ["fp"]).join(first, "fp").where("id != first").select("id", "first")
    return linked.unionByName(shared.toDF("first_a", "first_b")).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))


def set_links(distinct: DataFrame, texts: DataFrame, shingle: int, scope: Scope) -> DataFrame:
    """Distinct sets (id, k, fp, n, sketch, short, prefix) to edges (a, b) between SIMILAR sets that have the same components as all such pairs.

    The ring of the fingerprints gives the candidates that differ least. What lies between its radius and SIMILAR, some ten bits of 64, no ring
    of segments prunes; so sets also meet in buckets of a shingle of both prefixes, which no SIMILAR pair misses. First each member is held
    against the first one of its bucket, which joins groups of near copies at a linear cost; then all pairs of a bucket whose members are in
    different components, those of a crowded bucket block against block. Length, position and sketch drop no SIMILAR pair; what they leave is
    compared set by set.
    """
    own = Scope()
    keyed = distinct.select("id", "n", F.posexplode("prefix").alias("pos", "shingle"))
    counts = own.write(keyed.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    met = semi_join(keyed, counts, ["shingle"], keep="many").withColumn("g", F.ceil(F.col("many") / CROWD).cast("long")).drop("many")
    met = own.write(met.withColumn("block", F.pmod(F.col("id"), F.col("g"))), "near-met")
    own.drop(counts)
    stars = _ring_pairs(distinct, own)
    for o in (F.col("id"), F.xxhash64("id", "shingle")):  # the first of a bucket: one order for all buckets, then one for each
        buckets = met.groupBy("shingle", "block").agg(F.collect_list(F.struct(o.alias("o"), "id", "n", "pos")).alias("members")).where(F.size("members") > 1).select("members")
        stars = stars.unionByName(buckets.mapInArrow(_star_pairs, "a long, b long"))
    edges = _verified(_screened(stars, distinct), distinct, texts, shingle, scope)
    roots = own.write(components(edges, own), "near-star-roots")
    labelled = own.write(met.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node"), "near-labelled")
    own.drop(met)
    open_keys = own.write(labelled.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("shingle", "n"), "near-open")
    left = semi_join(labelled, open_keys, ["shingle"])
    # the pairs of blocks i <= j that a member is part of
    left = left.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    left = left.join(distinct.select("id", "short"), "id")
    crosses = left.groupBy("shingle", "i", "j").agg(F.collect_list(F.struct("id", "n", "pos", "root", "block", "short")).alias("members")).where(F.size("members") > 1).select("i", "j", "members")
    crossing = _verified(_screened(crosses.mapInArrow(_cross_pairs, "a long, b long"), distinct), distinct, texts, shingle, scope)
    own.drop()
    return edges.unionByName(crossing)


def _row_key(*columns: Column) -> Column:
    """128 bits of a row's content, as two numbers."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def _set_ids(sets: DataFrame, scope: Scope) -> DataFrame:
    """`sets` with `id`, a number of 64 bits from the digest, which has 128; sets whose numbers collide get others."""
    taken = scope.write(sets.groupBy(F.xxhash64("digest").alias("taken")).agg(F.count("*").alias("n")).where("n > 1"), "near-collisions")  # a few at 10^10 sets
    found = sets.withColumn("first_id", F.xxhash64("digest")).join(F.broadcast(taken), F.col("first_id") == F.col("taken"), "left")
    return found.withColumn("id", F.when(F.col("taken").isNull(), F.col("first_id")).otherwise(F.xxhash64(F.lit("second"), "digest"))).drop("first_id", "taken")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of near copies, the one with the least id, with the columns of `docs`; ties and null ids go by a text hash.

    Near copies have sets of shingles with a Jaccard similarity of 0.8 or more; groups are the components of all such pairs. Every pair is
    found: candidates by the fingerprints' ring and by prefix filter, length, position and sketch, then the exact similarity. Texts without words are one group.
    """
    scope = Scope()
    key = _row_key(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    who = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), key.alias("k")).alias("who")
    texts = docs.select(who, F.col(text_col).alias("text"))
    prints = scope.write(_set_prints(texts, shingle), "near-prints")
    repeated = scope.write(prints.groupBy("who.k").count().where("count > 1").select("k", F.lit(True).alias("twice")), "near-repeated")
    grouped = prints.groupBy("digest").agg(F.min("who").alias("first"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"), F.first("prefix").alias("prefix"))
    sets = scope.write(grouped.select("digest", "first", F.col("first.k").alias("k"), "fp", F.col("n").alias("size"), "sketch", "short", "prefix"), "near-sets-of-texts")
    scope.drop(prints)
    distinct = _set_ids(sets, scope).drop("n", "digest").withColumnRenamed("size", "n")
    edges = set_links(distinct.drop("first"), texts, shingle, scope)
    roots = scope.write(components(edges, scope), "near-roots")
    rooted = distinct.select("id", "first").join(roots, F.col("id") == F.col("node"), "left")
    least = rooted.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    keepers = Written(least.select(F.col("first.k").alias("k")).join(repeated, "k", "left").select(F.col("k").alias("__gw_keep"), F.coalesce("twice", F.lit(False)).alias("__gw_twice")), "near-keepers").df
    scope.drop()
    if keepers.count() <= BROADCAST_TEXTS:
        keepers = F.broadcast(keepers)
    keyed_docs = docs.withColumn("__gw_key", key)
    on = keyed_docs["__gw_key"] == F.col("__gw_keep")
    # texts are only shuffled where a row repeats, id and text
    once, twice = (keyed_docs.join(keepers.where(F.col("__gw_twice") == x), on, "left_semi") for x in (False, True))
    return once.unionByName(twice.dropDuplicates(["__gw_key"])).drop("__gw_key")
