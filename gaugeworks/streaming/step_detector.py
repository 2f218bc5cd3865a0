"""Step boundaries on a growing stream of text: rows (generation, seq, piece) to completed steps, each once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import ANSWER_MARKERS, STEP_MARKER


def split_ready(text: str) -> tuple[list[str], str]:
    """Completed steps at the front of a text, and what is still growing. A step ends where the next step or an answer begins."""
    done = []
    while True:
        first = text.find(STEP_MARKER)
        ends = [text.find(STEP_MARKER, first + len(STEP_MARKER) if first >= 0 else 0), *(text.find(m, 1) for m in ANSWER_MARKERS)]
        ends = [e for e in ends if e > 0]
        if not ends:
            return done, text
        at = min(ends)
        if text[:at].strip():
            done.append(text[:at].strip())
        text = text[at:]


def detect_steps(stream: DataFrame) -> DataFrame:
    """Keyed state holds the unfinished text and the number of the next step of each generation."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, number = state.get if state.exists else ("", 0)
        pieces = pd.concat(list(batches)).sort_values("seq")
        done, text = split_ready(text + "".join(pieces["piece"]))
        state.update((text, number + len(done)))
        yield pd.DataFrame({"generation": [key[0]] * len(done), "step": range(number, number + len(done)), "text": done}).astype({"generation": "int64", "step": "int32"})

    return stream.groupBy("generation").applyInPandasWithState(run, "generation long, step int, text string", "text string, number int", "append", GroupStateTimeout.NoTimeout)
