"""External lookups: a fetcher that rests after a failure, applied to distinct texts in Arrow batches.

``fetch(text) -> str | None`` returns an HTML fragment, and raises where the source can't be reached. Without a network a
table of saved fragments does the same through ``saved``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteverify.functions import constants as C
from quoteverify.functions.fuzzy import fuzz_partial_ratio
from quoteverify.functions.normalize import normalize, words
from quoteverify.operators.cards import parse_cards

ENTRIES = "array<struct<text:string,narrator:string,scholar:string,source:string,number:string,grade:string>>"


class Breaker:
    """Calls a function, and after a failure none for a while: None says that the source was not reached."""

    def __init__(self, call: Callable, pause: float = C.BREAKER_PAUSE, clock: Callable[[], float] = time.time):
        self.call, self.pause, self.clock, self.rests_until = call, pause, clock, float("-inf")

    def __call__(self, text: str):
        if self.clock() < self.rests_until:
            return None
        try:
            return self.call(text)
        except Exception:
            self.rests_until = self.clock() + self.pause
            return None


def first_that_answers(models: list, call: Callable, kind_of: Callable[[Exception], str], wait: Callable[[], None] = lambda: None):
    """Tries the models in turn. A busy one is tried once more; one that is busy, missing or used up gives way to the next;
    any other error ends it. Of the errors a used-up quota is reported before others."""
    errors: dict[str, Exception] = {}
    for model in models:
        for again in (False, True):
            try:
                return call(model)
            except Exception as error:
                kind = kind_of(error)
                errors[kind] = errors["last"] = error
                if kind == "error":
                    raise
                if kind != "busy" or again:
                    break
                wait()
    raise errors.get("quota") or errors.get("last") or RuntimeError("no model")


_breakers: dict[str, Breaker] = {}


def shared_breaker(fetch: Callable[[str], str | None], pause: float, source: str) -> Breaker:
    """The worker process's breaker of a source. Worker processes stay for a session, so a source that fails rests for all
    later tasks of the process, not for the current one alone."""
    if source not in _breakers:
        _breakers[source] = Breaker(fetch, pause)
    _breakers[source].call = fetch
    return _breakers[source]


def lookup(texts: DataFrame, fetch: Callable[[str], str | None], pause: float = C.BREAKER_PAUSE, source: str = "") -> DataFrame:
    """(text, entries, reached) of the distinct texts. Entries are null where the source was not reached, and empty where it
    had none. A dead source costs one call a pause in each worker process; ``source`` names it where there are several."""

    def run(batches):
        breaker = shared_breaker(fetch, pause, source)
        for batch in batches:
            pages = [breaker(t) for t in batch.column("text").to_pylist()]
            entries = pa.array([None if p is None else parse_cards(p) for p in pages], pa.list_(pa.struct([(n, pa.string()) for n in ("text", "narrator", "scholar", "source", "number", "grade")])))
            yield pa.RecordBatch.from_arrays([batch.column("text"), entries, pa.array([p is not None for p in pages])], ["text", "entries", "reached"])

    return texts.select("text").distinct().mapInArrow(run, f"text string, entries {ENTRIES}, reached boolean")


def saved(texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """The same from a table of saved fragments (text, html); a text without one was not reached."""
    from pyspark.sql.functions import pandas_udf

    parsed = pandas_udf(lambda s: s.map(parse_cards), ENTRIES)
    return texts.select("text").distinct().join(fragments, "text", "left").select("text", F.when(F.col("html").isNotNull(), parsed(F.coalesce("html", F.lit("")))).alias("entries"), F.col("html").isNotNull().alias("reached"))


def same_wording(found: DataFrame) -> DataFrame:
    """(text, entry_no, entry) of the entries that have the text's wording (of two words or more)."""
    each = found.select("text", F.posexplode("entries").alias("entry_no", "entry"))
    normal = normalize(F.col("text"))
    return each.where(F.size(words(normal)) >= 2).withColumn("partial", fuzz_partial_ratio(normal, normalize(F.col("entry.text")))).where(F.col("partial") >= C.EXTERNAL_PARTIAL).drop("partial")
