"""Teacher-forced scores of candidate texts through a prefix tree: what candidates of one prompt begin alike is scored once."""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.calls import Answers
from ..sources.providers import PAIR

#: Candidates of an Arrow batch that are Python objects at once.
ROWS = 64
#: Characters of a candidate that say to which stretch it goes, and candidates looked at for each stretch.
HEAD, SAMPLED = 1000, 10
#: Characters of a key before the words: the digest of the prompt. The sign that a blank within a word, and itself, are written with.
DIGEST, ESCAPE = 32, "\x1f"


def prefixes(rows: DataFrame) -> DataFrame:
    """`rows` with `keys`: the digest of each prefix of the tokens w, 16 bytes, from one pass over them."""

    schema = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch, found = whole.slice(at, ROWS), []
                for words in batch.column("w").to_pylist():
                    h, keys = hashlib.sha256(), []
                    for w in words or ():
                        data = w.encode()
                        h.update(len(data).to_bytes(8, "big") + data)
                        keys.append(h.copy().digest()[:16])
                    found.append(keys)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.binary()))], schema.names)

    return rows.mapInArrow(run, schema)


def _key(prompt: Column, words: Column) -> Column:
    """The prompt's digest and the words, a blank behind each: keys in order are a walk through the trees of all prompts."""
    plain = F.concat(F.array_join(words, " "), F.lit(" "))
    escaped = F.transform(words, lambda t: F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPE + "1")), F.lit(" "), F.lit(ESCAPE + "0")))
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) != F.size(words)) | plain.contains(ESCAPE)
    said = F.when(F.size(words) == 0, "").when(odd, F.concat(F.array_join(escaped, " "), F.lit(" "))).otherwise(plain)
    return F.concat(F.substring(F.sha2(prompt, 256), 1, DIGEST), said)


def _words(key: str) -> list[str]:
    words = key[DIGEST:-1].split(" ") if len(key) > DIGEST else []
    return [w.replace(ESCAPE + "0", " ").replace(ESCAPE + "1", ESCAPE) for w in words] if ESCAPE in key else words


def _shared(a: str, b: str) -> int:
    """The number of words that two keys begin with alike; none under different prompts."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        low = high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a.count(" ", DIGEST, low) if low > DIGEST else 0


def _first(key: str, n: int) -> str:
    """A key's first n words."""
    at = DIGEST - 1
    for _ in range(n):
        at = key.index(" ", at + 1)
    return key[: at + 1]


def _call(prompt: str, words: list[str], start: int, stop: int) -> str | None:
    """What is asked for an edge; nothing if its words are empty."""
    asked = " ".join(words[start:stop])
    return " ".join(x for x in (prompt, " ".join(words[:start])) if x) + PAIR + asked if asked else None


def _bounds(rows: DataFrame, n: int) -> list[tuple[str, str]]:
    """Keys at which stretches begin, n at most, in order, each with its prompt: of each the fewest words that tell it from the one before."""
    if n < 2:
        return []
    least = -(2**63) + 2**64 * SAMPLED * n // max(1, rows.count())  # of hashes in order, as many as are wanted
    some = rows.where(F.xxhash64("g", "i") <= min(least, 2**63 - 1)).select(F.substring("key", 1, DIGEST + HEAD).alias("head"), "p").collect()
    heads = sorted((r.head[: max(DIGEST, r.head.rfind(" ") + 1)], r.p) for r in some)
    found: dict[str, str] = {}
    for k in sorted({len(heads) * k // n for k in range(1, n)} if heads else ()):
        head, prompt = heads[k]
        before = bisect_right(heads, head, hi=k, key=lambda x: x[0]) - 1
        while before >= 0 and heads[before][0] == head:
            before -= 1
        if before >= 0:
            begin = head[:DIGEST] if heads[before][0][:DIGEST] != head[:DIGEST] else _first(head, _shared(heads[before][0], head) + 1)
            found[begin] = prompt
    return sorted(found.items())


def _crown(rows: DataFrame, bounds: list[tuple[str, str]], answers: Answers) -> list[tuple[str, list]]:
    """For each bound, what candidates on both sides of it begin with, and the edges of it: their stops and the answers' values (null if one failed).

    Candidates part from a bound where a candidate next to it does, so that each stretch can find its own edges beyond.
    """
    keys = [b for b, _ in bounds]

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for part, head in zip(batch.column("part").to_pylist(), batch.column("head").to_pylist()):
                found |= {(k, k == part, d) for k in (part - 1, part) if 0 <= k < len(keys) for d in [_shared(keys[k], head)] if 0 < d}
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (pa.int32(), pa.bool_(), pa.int32()))], ["k", "left", "depth"])

    met = rows.select("part", F.substring("key", 1, DIGEST + HEAD).alias("head")).mapInArrow(depths, "k int, left boolean, depth int").distinct().collect() if keys else []
    # whoever begins with the whole bound does not part from it
    ends = {_first(keys[r.k], r.depth) for r in met if r.depth < keys[r.k].count(" ")}
    deep = [max((r.depth for r in met if r.k == k and r.left), default=0) for k in range(len(keys))]
    paths, calls = [], {}
    for (key, prompt), most in zip(bounds, deep):
        nodes = [(d, node) for d in range(1, most + 1) for node in [_first(key, d)] if node in ends]
        for (start, _), (stop, node) in zip([(0, ""), *nodes], nodes):
            calls[node] = _call(prompt, _words(node), start, stop)
        paths.append((_first(key, most), nodes))
    said = {}
    if calls:
        spark = rows.sparkSession
        asked = answers.ask(spark.createDataFrame(list(calls.items()), "node string, call string"), "call")
        said = {r.node: r.lls for r in asked.select("node", "lls").collect()}
    return [(key, [(stop, said[node]) for stop, node in nodes]) for key, nodes in paths]


class _Walk:
    """Through the candidates of a stretch in order of their keys, kept in a file meanwhile: where edges end is known only when all have been seen."""

    def __init__(self, crown: list[tuple[str, list]]):
        self.crown = crown

    def stretches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[pa.RecordBatch, list]]]:
        def slices():
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    batch = whole.slice(at, ROWS)
                    parts, begin = batch.column("part").to_pylist(), 0
                    for part, same in groupby(parts):
                        n = len(list(same))
                        yield part, batch.slice(begin, n)
                        begin += n

        for part, found in groupby(slices(), lambda x: x[0]):
            yield self._one([self.crown[k] for k in (part - 1, part) if 0 <= k < len(self.crown)], (b for _, b in found))

    def _one(self, sides: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Batches, and for each candidate the words that it shares with the one before it, the edges of a bound (or none) that lead further than
        those, and its own edges: start, stop and call."""
        like, size, known, side = array("q"), array("q"), array("q"), array("b")
        before = ""
        with tempfile.TemporaryFile() as file:
            writer = None
            for batch in batches:
                writer = writer or pa.ipc.new_stream(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(batch)
                for key in batch.column("key").to_pylist():
                    like.append(_shared(before, key))
                    size.append(key.count(" ", DIGEST))
                    deep, at = max(((_shared(x[0], key), k) for k, x in enumerate(sides)), default=(0, 0))
                    known.append(deep)
                    side.append(at)
                    before = key
            writer.close()
            cuts, ends, open_ = array("q"), array("q", [0]), []  # from the last candidate to the first
            for j in range(len(like) - 1, -1, -1):
                begin = bisect_right(open_, max(like[j], known[j]))
                cuts.extend(d for d in reversed(open_[begin:]) if d < size[j])
                ends.append(len(cuts))
                del open_[bisect_right(open_, like[j] - 1) :]
                if like[j]:
                    open_.append(like[j])
            cuts.reverse()
            file.seek(0)
            j = 0
            for batch in pa.ipc.open_stream(file):
                rows = []
                for prompt, key in zip(batch.column("p").to_pylist(), batch.column("key").to_pylist()):
                    start, words = max(like[j], known[j]), _words(key)
                    own = cuts[len(cuts) - ends[len(like) - j] : len(cuts) - ends[len(like) - j - 1]]
                    stops = [*own, size[j]] if start < size[j] else []
                    edges = [(a, b, _call(prompt, words, a, b)) for a, b in zip([start, *stops], stops)]
                    rows.append((like[j], sides[side[j]][1] if known[j] > like[j] else None, start, edges))
                    j += 1
                yield batch, rows


def forced_scores(candidates: DataFrame, group: str, index: str, prompt: Column, tokens: str, answers: Answers) -> DataFrame:
    """group, index and `lls`, the log-likelihood of each token of a candidate given the prompt and the tokens before it.

    One call for each edge of a prompt's prefix tree: its context is the prompt and the tokens before the edge. The provider gives `lls` for the
    words behind PAIR, and must score each by what stands before it: then the values equal those of each candidate scored alone. Candidates are
    unique by group and index, indices and tokens are not null; a candidate without tokens has no values. Groups may be of any size.

    Candidates are shuffled once, as texts in order, to stretches in which they follow each other as in the tree. An edge is asked for where its
    first candidate lies; those behind it take its values over. What crosses a bound between stretches is asked for before them. Copies, and
    what begins with the same HEAD characters, share a stretch. No table has a row for each token. `candidates` is read four times, six if the table of answers is not new.
    """
    spark = candidates.sparkSession
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    rows = candidates.select(F.col(group).alias("g"), F.col(index).alias("i"), F.coalesce(prompt, F.lit("")).alias("p"), words.alias("w"))
    rows = rows.select("g", "i", "p", _key(F.col("p"), F.col("w")).alias("key"))
    asked_before = answers.any()
    bounds = _bounds(rows, answers.in_flight)
    part = F.size(F.filter(F.array(*(F.lit(b) for b, _ in bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    walk = _Walk(_crown(rows, bounds, answers))
    if asked_before:
        rows = rows.join(_answered(rows, walk, answers, len(bounds) + 1), F.col("g").eqNullSafe(F.col("kg")) & (F.col("i") == F.col("ki")), "left").drop("kg", "ki")
    else:
        rows = rows.withColumn("known", F.lit(None).cast(T.ArrayType(answers.schema)))
    laid = _laid(rows, len(bounds) + 1)
    kind = T.StructType([laid.schema["g"], laid.schema["i"], T.StructField("shared", T.ArrayType(T.DoubleType())), T.StructField("asked", T.ArrayType(answers.schema))])
    calls, arrow_kind, answer_kind = answers.caller(), to_arrow_schema(kind), pa.struct(to_arrow_schema(answers.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in walk.stretches(batches):
            path: list = []  # the edges that lead to a candidate: stop and values
            for batch, rows in stretch:
                listed = batch.column("known")
                found = [listed.flatten()]
                place = {k: n for n, k in enumerate(found[0].field("prompt_key").to_pylist())} if len(found[0]) else {}
                places, ends = [], [0]

                def prompts():
                    n = len(found[0])
                    for _, _, _, edges in rows:
                        for _, _, call in edges:
                            key = call and hashlib.sha256(call.encode()).hexdigest()
                            if key and key not in place:
                                place[key], n = n, n + 1
                                yield key, call
                            places.append(place.get(key))
                        ends.append(len(places))

                found += [b.to_struct_array() for table in calls(prompts()) for b in table.combine_chunks().to_batches()]
                own = pa.concat_arrays([f.cast(answer_kind) for f in found]).take(pa.array(places, pa.int64()))
                values, shared = own.field("lls"), []
                for (like, side, start, edges), at in zip(rows, ends):
                    path = [(stop, x if x is None or isinstance(x, pa.Array) else pa.array(x, pa.float64())) for stop, x in (side if side is not None else path) if stop <= (start if side is not None else like)]
                    shared.append(None if any(x is None for _, x in path) else pa.concat_arrays([pa.array([], pa.float64()), *(x for _, x in path)]))
                    for k, (_, stop, _) in enumerate(edges, at):
                        ok = own[k].is_valid and values[k].is_valid
                        path.append((stop, pa.concat_arrays([pa.array([], pa.float64()), values[k].values]) if ok else None))
                sizes = [0 if x is None else len(x) for x in shared]
                begins = pa.array(accumulate(sizes, initial=0), pa.int32())
                column = pa.ListArray.from_arrays(begins, pa.concat_arrays([pa.array([], pa.float64()), *(x for x in shared if x is not None)]), mask=pa.array([x is None for x in shared]))
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("i"), column, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], schema=arrow_kind)

    scored = answers.keep(laid.mapInArrow(run, kind))
    lls = F.concat("shared", F.flatten(F.transform("asked", lambda a: a["lls"])))
    return scored.select(F.col("g").alias(group), F.col("i").alias(index), F.coalesce(lls, F.array().cast("array<double>")).alias("lls"))


def _laid(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("key")


def _answered(rows: DataFrame, walk: _Walk, answers: Answers, n: int) -> DataFrame:
    """kg, ki and `known`: the answers that there are to the calls of a candidate."""
    laid = _laid(rows, n)
    kind = T.StructType([laid.schema["g"], laid.schema["i"], T.StructField("prompt_key", T.StringType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in chain.from_iterable(walk.stretches(batches)):
            calls = [(k, hashlib.sha256(call.encode()).hexdigest()) for k, row in enumerate(rows) for _, _, call in row[3] if call]
            at = pa.array([k for k, _ in calls], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("i").take(at), pa.array([x for _, x in calls], pa.string())], kind.names)

    found = laid.mapInArrow(keys, kind).join(answers.written().where(F.col("error").isNull()), "prompt_key")
    return found.groupBy(F.col("g").alias("kg"), F.col("i").alias("ki")).agg(F.collect_list(F.struct(*answers.schema.names)).alias("known"))
