"""Secret scans: pattern matches, and dictionary-primed zstandard novelty.

Base spans are the leftmost non-overlapping matches of each kind. The method adds spans of kind `novel`: strings within REACH code points behind
a sensitive word, on its line, that hold letters with digits or of both cases, and whose marginal compressed size, after a dictionary of common
identifiers and CONTEXT code points of text on either side, stays close to their own length.

A null text counts as empty and has no span; its digest is that of the empty text. Spans of one start keep the order of KINDS. Repeated rows
are scanned each; an empty table gives an empty result. A base span is never dropped; a novel span never overlaps another span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_buffer

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Words that make the next string sensitive.
SENSITIVE_WORDS = (b"auth", b"bearer", b"credential", b"private", b"signature", b"session", b"cookie", b"passphrase", b"passwd", b"password", b"secret", b"token", b"client_id", b"access", b"key", b"pwd")
SENSITIVE = re.compile("|".join(w.decode() for w in SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_~.@-])[A-Za-z0-9+/_][A-Za-z0-9+/_~.-]{10,}[A-Za-z0-9+/_~-]={0,2}")
#: Identifiers that code and configuration files share.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key apikey private_key public_key secret_key password passwd username user_name "
    "session_id session_token authorization bearer credential credentials certificate signature encrypted decrypt configuration environment "
    "production development localhost database connection_string endpoint service_account project_id request response function return import "
    "class public static void string integer boolean object array undefined null true false default value example placeholder changeme "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 http https www com org net json xml yaml config settings token"
)
CONTEXT = 256
REACH = 40
#: Marginal bytes for each byte of the candidate from which it counts as novel.
NOVELTY = 0.7

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal_bytes(zstd: zstandard.ZstdCompressor, before: str, candidate: str, after: str) -> int:
    """How many more compressed bytes the surroundings take with the candidate than without it."""
    around = before.encode() + b" " + after.encode() + b" "
    return len(zstd.compress(around + candidate.encode())) - len(zstd.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in code points; failing matches still use up their text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of this class is maximal, so a bound on the repeat equals dropping the short runs
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{%d,}" % LEAST["hex"], text)]
    return sorted(found)


def mixed(candidate: str) -> bool:
    """Letters with digits, or capitals closer than those of joined words; words and paths in one case are left alone."""
    upper, lower, digits = (sum(map(test, candidate)) for test in (str.isupper, str.islower, str.isdigit))
    return (digits >= 2 and upper + lower >= 2) or (upper >= 3 and lower >= 3 and len(candidate) < 3 * upper)


def novel_spans(zstd: zstandard.ZstdCompressor, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int, int]] = []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    last = 0
    for m in CANDIDATE.finditer(text) if words else ():
        lo, hi = m.span()
        while last + 1 < len(words) and words[last + 1][1] <= lo:
            last += 1
        end = words[last][1]
        if not (lo - REACH <= end <= lo) or "\n" in text[end:lo] or not mixed(m[0]):
            continue
        if any(s < hi and lo < e for s, _, e in taken):
            continue
        if marginal_bytes(zstd, text[max(0, lo - CONTEXT) : lo], m[0], text[hi : hi + CONTEXT]) >= NOVELTY * (hi - lo):
            found.append((lo, 3, hi))
    return found


def _suspects(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts may hold any span: those with a long enough run of hex digits, or with a word that a pattern needs."""
    out = np.zeros(len(lengths), bool)
    view = data.data if len(data) else b""
    for k in np.flatnonzero(lengths >= LEAST["assign"]):
        part = data[starts[k] : starts[k] + lengths[k]]
        raw = bytes(view[starts[k] : starts[k] + lengths[k]])
        low = raw.lower()
        if any(w in low for w in ASSIGN_WORDS) or b"AKIA" in raw or any(w in low for w in SENSITIVE_WORDS):
            out[k] = True
            continue
        # every run of 24 covers one of the positions 23, 47, ... fully surrounded: look there first
        probes = np.flatnonzero(_IS_HEX[part[LEAST["hex"] - 1 :: LEAST["hex"]]])
        if len(probes):
            edges = np.flatnonzero(~_IS_HEX[part])
            gaps = np.diff(np.concatenate([[-1], edges, [len(part)]])) - 1
            out[k] = bool((gaps >= LEAST["hex"]).any())
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _scan_batch(column: pa.Array, zstd: zstandard.ZstdCompressor) -> Iterator[list[tuple[int, int, int]]]:
    suspects = _suspects(*text_buffer(column))
    for k, suspect in enumerate(suspects):
        if not suspect:
            yield []
            continue
        text = column[k].as_py()
        base = base_spans(text)
        yield sorted(base + novel_spans(zstd, text, base))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts of the base kinds, digest of the base spans, all spans, number of novel spans, and of each span its
    marginal compressed bytes per byte."""
    docs = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = _compressor()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, novelty = [], [], []
            for row, found in enumerate(_scan_batch(batch.column(1), zstd)):
                text = batch.column(1)[row].as_py() if found else ""
                novelty.append([round(marginal_bytes(zstd, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]) / (e - s), 3) for s, _, e in found])
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                base = [x for x in found if x[1] < 3]
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest() if base else nothing)
                spans.append(_join(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64()), pa.array(novelty, pa.list_(pa.float64()))], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "novelty"]
    long, text = T.LongType(), T.StringType()
    kinds = [docs.schema[id_col].dataType, long, long, long, text, text, long, T.ArrayType(T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """All rows of `docs`, same columns: every span of a text is replaced by `mask`, and `length_col` counts the new text's code points.

    Overlapping spans are replaced as one. Texts without a span, and their lengths, stay as they are.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = _compressor()
        for batch in batches:
            changed: dict[int, str] = {}
            for k, found in enumerate(_scan_batch(batch.column(at), zstd)):
                if found:
                    text, parts, last = batch.column(at)[k].as_py(), [], 0
                    for s, _, e in found:
                        if s >= last:
                            parts += [text[last:s], mask]
                        last = max(last, e)
                    changed[k] = "".join([*parts, text[last:]])
            columns = list(batch.columns)
            if changed:
                texts = columns[at].to_pylist()
                lengths = columns[length_at].to_pylist() if length_at is not None else None
                for k, text in changed.items():
                    texts[k] = text
                    if lengths is not None:
                        lengths[k] = len(text)
                columns[at] = pa.array(texts, columns[at].type)
                if lengths is not None:
                    columns[length_at] = pa.array(lengths, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
