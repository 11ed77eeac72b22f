"""Outside models behind column expressions: text embedding and text completion.

A model is given as a function without arguments that makes it. It is made once in each Python worker and called with Arrow batches, so an
expensive model is loaded once a worker and never once a row. The embedding that comes with the library hashes words and needs no files.
"""

from __future__ import annotations

import json
import re
import sys
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embed = Callable[[list[str]], np.ndarray]
Complete = Callable[[str], str | None]


def hashed_words(width: int = 256) -> Callable[[], Embed]:
    """An embedding without a model: every word and pair of words adds one to a hashed place, up or down."""

    def make() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts, strict=True):
                words = re.findall(r"\w+", text.lower())
                for part in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                    h = zlib.crc32(part.encode())
                    row[h % width] += 1 if h >> 31 else -1
            return out

        return embed

    return make


def embedded(text: Column, make: Callable[[], Embed] | None = None, batch: int = 256) -> Column:
    """Unit vectors of texts as array<double>. A null text counts as empty; a vector of zeros stays one."""
    make = make or hashed_words()

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                vectors = np.asarray(model(texts[k : k + batch]), np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                rows += list(vectors / np.where(norms > 0, norms, 1))
            yield pd.Series(rows, dtype=object)

    return run(text)


def is_json_array(raw: str) -> bool:
    """Whether the text, or its widest bracketed part, is a JSON array."""
    for part in (raw, *(m.group() for m in [re.search(r"\[.*\]", raw, re.DOTALL)] if m)):
        try:
            if isinstance(json.loads(part), list):
                return True
        except ValueError:
            continue
    return False


def completed(prompt: Column, make: Callable[[], Complete], attempts: int = 2, wait: float = 1.0, accept: Callable[[str], bool] = is_json_array) -> Column:
    """The model's answers to prompts. A call that raises, gives None or an answer that is not accepted is tried again after a wait, up to
    ``attempts`` times in all; then the answer is null. Null prompts are not sent. Of equal prompts in a batch one is sent."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def ask(text: str) -> str | None:
            for attempt in range(attempts):
                try:
                    answer = model(text)
                except Exception:  # whatever an outside model raises; the row's answer is null after the last attempt
                    answer = None
                if answer is not None and accept(answer):
                    return answer
                if attempt + 1 < attempts:
                    time.sleep(wait)
            return None

        for part in parts:
            known = {text: ask(text) for text in dict.fromkeys(part.dropna())}
            yield pd.Series([known.get(text) for text in part], dtype=object)

    return run(prompt)


def http_completion(url: str, model: str, seconds: float = 120.0) -> Callable[[], Complete]:
    """A model behind a JSON endpoint that takes model, prompt and stream, and answers with a field named response."""

    def make() -> Complete:
        from urllib.request import Request, urlopen

        def ask(prompt: str) -> str | None:
            body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
            with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=seconds) as reply:
                return json.load(reply).get("response") if reply.status == 200 else None

        return ask

    return make
