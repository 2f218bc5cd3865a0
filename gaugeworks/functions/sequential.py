"""Text operators that read their input in order: plain Python on one text, and Arrow functions over columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from .stemmer import stem

#: Abbreviations whose dot ends no sentence, and the shortest sentence that stands alone.
ABBREVIATIONS = frozenset(("e.g", "i.e", "mr", "mrs", "ms", "dr", "prof", "vs", "no", "etc"))
SHORTEST = 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~ \n"


def sentence_ends(text: str) -> Iterator[int]:
    """Positions after . ! ? that end a sentence."""
    for i, ch in enumerate(text):
        if ch not in ".!?":
            continue
        if ch == "." and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            continue
        head = text[:i].rstrip()
        k = len(head)
        while k and (head[k - 1].isalpha() or head[k - 1] in "’'"):
            k -= 1
        if head[k:].strip("’'").lower() in ABBREVIATIONS:
            continue
        yield i + 1


def merged_sentences(text: str | None) -> list[str]:
    """Sentences and the rest; one under SHORTEST characters joins the one before it."""
    text, out, last = text or "", [], 0
    for end in [*sentence_ends(text), len(text)]:
        piece = text[last:end].strip()
        last = end
        if piece:
            if out and len(piece) < SHORTEST:
                out[-1] = f"{out[-1]} {piece}"
            else:
                out.append(piece)
    return out


def thinking_sentences(text: str | None) -> list[str]:
    """Merged sentences of the thinking part: from <think> to </think>; an unfinished rest is dropped."""
    text = (text or "").split("</think>")[0]
    text = text.split("<think>", 1)[-1].replace("�", "")
    ends = list(sentence_ends(text))
    return merged_sentences(text[: ends[-1]]) if ends else []


def match_mask(sentence: str, matches: list[str]) -> str | None:
    """'^' under the words, found in order at word borders; null if one is not found."""
    mask, left, pos = [" "] * len(sentence), list(matches), 0
    while pos < len(sentence) and left:
        end = pos + len(left[0])
        free = (pos == 0 or not sentence[pos - 1].isalpha()) and (end >= len(sentence) or not sentence[end].isalpha())
        if left[0] and free and sentence.startswith(left[0], pos):
            mask[pos:end] = "^" * len(left.pop(0))
            pos = end
        else:
            pos += 1
    return None if left else "".join(mask)


def tokens_of_mask(mask: str, tokens: list[str]) -> list[int]:
    """Tokens, laid end to end, that hold a marked character."""
    out, at = [], 0
    for k, token in enumerate(tokens):
        if "^" in mask[at : at + len(token)]:
            out.append(k)
        at += len(token)
    return out


def merge_words(tokens: list[str], confidences: list[float]) -> list[tuple[str, float]]:
    """Tokens joined to words at punctuation and spaces, each with its least confidence."""
    out, word, least = [], "", math.inf
    for token, c in zip(tokens, confidences, strict=True):
        if token in PUNCTUATION:
            if word:
                out.append((word, least))
            out.append((token, c))
            word, least = "", math.inf
        else:
            word, least = word + token, min(least, c)
    if word:
        out.append((word, least))
    return out


def with_spaces(tokens: list[str], text: str) -> list[str]:
    """Decoded tokens with the space that follows them in the text they were decoded from."""
    out, at = [], 0
    for token in tokens:
        at += len(token)
        gap = " " if text[at : at + 1] == " " else ""
        out.append(token + gap)
        at += len(gap)
    return out


_EDGES = re.compile(r"([{0}]*)(.*?)([{0}]*)\Z".format(re.escape(PUNCTUATION)), re.DOTALL)


def split_edges(tokens: list[str], confidences: list[float]) -> tuple[list[str], list[float]]:
    """Punctuation and spaces at either end of a token as tokens of their own, certain; blanks at the ends of the whole are dropped."""
    pieces: list[tuple[str, float]] = []
    for token, c in zip(tokens, confidences, strict=True):
        head, body, tail = _EDGES.match(token).groups()
        pieces += [*((p, 1.0) for p in head), *([(body, c)] if body else []), *((p, 1.0) for p in tail)]
    solid = [k for k, (p, _) in enumerate(pieces) if p not in (" ", "\n")]
    pieces = pieces[solid[0] : solid[-1] + 1] if solid else []
    return [p for p, _ in pieces], [c for _, c in pieces]


def ngrams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def f_measure(overlap: float, a: float, b: float) -> float:
    return 2 * overlap / (a + b) if overlap and a + b else 0.0


def rouge_n(a: list[str], b: list[str], n: int) -> float:
    x, y = ngrams(a, n), ngrams(b, n)
    return f_measure((x & y).total(), x.total(), y.total())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. Columns of the shorter text are bits of one number (0 where the length rises by one), so a word
    of the other costs a few operations on it; words of one text only are left out. Masks take the shorter text's words squared in bits at most."""
    both = set(a) & set(b)
    a, b = sorted(([w for w in a if w in both], [w for w in b if w in both]), key=len, reverse=True)
    masks: dict[str, int] = {}
    for k, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << k
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & masks[x]
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_l(a: list[str], b: list[str]) -> float:
    return f_measure(common_length(a, b), len(a), len(b))


def bleu(hypothesis: list[str], reference: list[str], weights: tuple[float, ...] = (0.25,) * 4) -> float:
    """Sentence BLEU with the brevity penalty; orders that the hypothesis is too short for are left out."""
    if not hypothesis or not reference:
        return 0.0
    logs, used = 0.0, 0.0
    for n, w in enumerate(weights, 1):
        x = ngrams(hypothesis, n)
        if not x:
            continue
        hit = (x & ngrams(reference, n)).total()
        if not hit:
            return 0.0
        logs, used = logs + w * math.log(hit / x.total()), used + w
    penalty = min(0.0, 1 - len(reference) / len(hypothesis))
    return math.exp(penalty + logs / used)


#: Stems of words that came lately.
_stem = lru_cache(1 << 16)(stem)


def overlap_words(text: str) -> list[str]:
    """Lower-cased runs of letters a-z and digits; those of more than three characters are stemmed."""
    return [_stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", (text or "").lower())]


def translation_words(text: str) -> list[str]:
    """Lower-cased words with punctuation apart, but for points and commas inside numbers and hyphens behind letters."""
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", (text or "").lower())
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def sentence_bleu(hypothesis: str, reference: str) -> float:
    """BLEU of one sentence, 0 to 100: a trailing point is cut, orders the hypothesis is too short for are left out, and an order without a
    hit counts as half a hit, then a quarter, and so on."""
    cut = lambda t: (t or "").strip().removesuffix(".")
    x, y = translation_words(cut(hypothesis)), translation_words(cut(reference))
    if not x or not y:
        return 0.0
    logs, orders, half = 0.0, 0, 1.0
    for n in range(1, 5):
        grams = ngrams(x, n)
        if not grams:
            break
        hit = (grams & ngrams(y, n)).total()
        if not hit:
            half *= 2
            hit = 1 / half
        logs, orders = logs + math.log(hit / grams.total()), orders + 1
    if not (ngrams(x, 1) & ngrams(y, 1)):
        return 0.0
    return 100 * math.exp(min(0.0, 1 - len(y) / len(x)) + logs / orders)


def lexical_score(a: str, b: str, kind: str, words: Callable[[str], list[str]] = overlap_words) -> float:
    if kind.startswith("rouge"):
        x, y = words(a), words(b)
        return rouge_l(x, y) if kind == "rougeL" else rouge_n(x, y, int(kind[5:]))
    if kind == "sentence_bleu":
        return sentence_bleu(a, b)
    x, y = (a or "").split(), (b or "").split()
    order = max(1, min(4, len(x), len(y)))
    return bleu(x, y, tuple([1 / order] * order))


def lexical_udf(kind: str):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        words = lru_cache(64)(overlap_words)  # pairs of a group follow each other and share their texts
        return pd.Series([lexical_score(x, y, kind, words) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


def text_list_udf(function):
    """An Arrow function text -> list of texts."""

    @F.pandas_udf("array<string>")
    def apply(text: pd.Series) -> pd.Series:
        return text.map(function)

    return apply


def focus(base: list[float], keyword: list[bool], edges: Iterable[tuple[int, int, float]], gamma: float = 0.9) -> float | None:
    """Mean over the keyword tokens of their own score and, scaled by gamma, the scores of the earlier keywords they attend to.

    edges: (token, earlier token, attention) in order of the first, each pair once. Work and memory follow their number.
    """
    scores = list(base)
    top, sums, weight = -1, 0.0, 0.0
    for k, j, a in [*edges, (len(base), 0, 0.0)]:
        if k != top:
            if weight:
                scores[top] += gamma * sums / weight
            top, sums, weight = k, 0.0, 0.0
        if j < k < len(base) and keyword[j]:
            sums, weight = sums + a * scores[j], weight + a
    kept = [s for s, use in zip(scores, keyword, strict=True) if use]
    return sum(kept) / len(kept) if kept else None


def smart_l(scores: list[list[float]]) -> float:
    """Soft longest common subsequence of sentences, by their match scores (premise times hypothesis), over the premise's length."""
    row = [0.0] * (len(scores[0]) + 1) if scores else []
    for line in scores:
        above, row = row, [0.0]
        for k, m in enumerate(line, 1):
            row.append(max(above[k - 1] + m, above[k] + m, row[k - 1]))
    return row[-1] / len(scores) if scores else 0.0


def smart_n(scores: list[list[float]]) -> float:
    """F-measure of the mean best match of the hypothesis's sentences and of the premise's."""
    if not scores or not scores[0]:
        return 0.0
    precision = sum(max(line[k] for line in scores) for k in range(len(scores[0]))) / len(scores[0])
    recall = sum(max(line) for line in scores) / len(scores)
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0
