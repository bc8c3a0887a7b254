"""Answers of a language model as a column: a pluggable function from text to text, with one retry."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.patterns import TRANSIENT

RETRY_SECONDS = 2.0


class Aborted(Exception):
    """Raised by a backend that was told to stop; never retried. Carries the text so far."""

    def __init__(self, text: str = ""):
        super().__init__(text)
        self.text = text


def echo(system: str, user: str) -> str:
    """The default backend: deterministic and offline."""
    return f"{len(system)}:{user[:60]}"


def with_retry(run: Callable[[], str], pause: float = RETRY_SECONDS) -> str:
    """Runs again once, after a pause, if the error looks transient."""
    try:
        return run()
    except Aborted:
        raise
    except Exception as error:
        if not re.search(TRANSIENT, str(error).lower()):
            raise
        time.sleep(pause)
        return run()


def echo_messages(messages: list[dict[str, str]]) -> str:
    """The default backend for message lists."""
    return f"{len(messages)}:{len(messages[0]['content'])}:{messages[-1]['content'][:60]}"


def _asked(requests: DataFrame, columns: list[str], open_backend: Callable[[], Callable[..., str]], pause: float) -> DataFrame:
    """Adds answer, aborted and error to rows whose columns are a backend's arguments. Other columns pass through Arrow untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = open_backend()
        for batch in batches:
            said: list[tuple[str | None, bool, str | None]] = []
            for arguments in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                try:
                    said.append((with_retry(lambda a=arguments: backend(*a), pause), False, None))
                except Aborted as stop:
                    said.append((stop.text, True, None))
                except Exception as error:  # any backend's error becomes the row's
                    said.append((None, False, str(error)))
            answers, aborted, errors = zip(*said, strict=True) if said else ((), (), ())
            added = [pa.array(answers, pa.string()), pa.array(aborted, pa.bool_()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "answer", "aborted", "error"])

    return requests.mapInArrow(run, requests._jdf.schema().toDDL() + ", answer string, aborted boolean, error string")


def infer(requests: DataFrame, open_backend: Callable[[], Callable[[str, str], str]] = lambda: echo, pause: float = RETRY_SECONDS) -> DataFrame:
    """From rows with (system, user): adds answer, aborted and error. A backend is opened once per task; a row's failure stays its own."""
    return _asked(requests, ["system", "user"], open_backend, pause)


def infer_messages(requests: DataFrame, open_backend: Callable[[], Callable[[list[dict[str, str]]], str]] = lambda: echo_messages, pause: float = RETRY_SECONDS) -> DataFrame:
    """The same for conversations: from rows with messages, an array of struct(role, content)."""
    return _asked(requests, ["messages"], open_backend, pause)


def missing_only(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a stored result, so that a rerun asks the model for nothing twice."""
    return requests.join(done.select(F.col(key)), key, "left_anti")
