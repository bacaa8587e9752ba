"""Tables out of free text, as a language model would return them."""

from __future__ import annotations

import csv
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

INVALID = "Not valid csv text, check the article"


def csv_block(text: str | None, delimiter: str = ",") -> str | None:
    """The first line of two fields or more and the lines right after it with
    as many fields; None without such lines."""
    lines = (text or "").splitlines()
    width = [len(next(csv.reader([x], delimiter=delimiter), [])) for x in lines]
    for i, n in enumerate(width):
        if n >= 2:
            j = i + 1
            while j < len(lines) and width[j] == n:
                j += 1
            if j > i + 1:
                return "\n".join(lines[i:j])
    return None


def token_gate(text: str, most: int = 200_000, count: Callable[[str], int] | None = None) -> bool:
    """Whether a text has fewer tokens than a model takes (by default four
    bytes are a token)."""
    return (count(text) if count else len(text.encode()) // 4) < most


def extract(texts: DataFrame, model: Callable[[str], str], most: int = 200_000) -> DataFrame:
    """(path, line, value, error): the model's table for each text, line by
    line; ``model`` is a plug-in, none is built in."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                if not token_gate(text or "", most):
                    rows.append((path, 0, None, "too long"))
                    continue
                try:
                    block = csv_block(model(text or ""))
                except Exception as e:  # a plug-in's failure is a row, not the job's
                    rows.append((path, 0, None, str(e)[:200]))
                    continue
                rows += [(path, i, v, None) for i, v in enumerate(block.splitlines())] if block else [(path, 0, INVALID, None)]
            yield pd.DataFrame(rows, columns=["path", "line", "value", "error"])

    return texts.mapInPandas(run, "path string, line int, value string, error string")
