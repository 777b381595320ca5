"""Catalogs straight from the providers, through a pluggable client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.operators.inference import RateLimited, TransportError, retry_wait

#: One page of a provider's catalog: (provider, token of the page, None for the first) -> (reply, token of the next).
Lister = Callable[[str, str | None], tuple[object, str | None]]

PAGES = "provider string, page int, raw string, error string"


def list_catalogs(
    providers: DataFrame, lister_factory: Callable[[], Lister], max_retries: int = 5,
    max_backoff_s: float = fixed.MAX_BACKOFF_SECONDS,
) -> DataFrame:
    """The pages of each provider's catalog: provider, page, raw (JSON as replied), error.

    Every provider is listed in a task of its own, page after page, so a slow or
    failing one holds up nobody else. A listing that fails ends with a row that
    carries the error, behind the pages it gave. Replies that ask for patience
    and lost connections are tried again. `catalog_ids` and `catalog_details`
    read the pages.
    """
    named = providers.select("provider").where("provider IS NOT NULL").distinct()
    # Providers are a handful; each gets a partition by its number.
    numbered = named.withColumn("_n", F.row_number().over(Window.orderBy("provider")) - 1)

    def page_of(ask: Lister, provider: str, token: str | None) -> tuple[object, str | None]:
        attempt = 0
        while True:
            try:
                return ask(provider, token)
            except (RateLimited, TransportError, ConnectionError, TimeoutError) as err:
                if attempt >= max_retries:
                    raise
                time.sleep(retry_wait(getattr(err, "retry_after", None), attempt, max_backoff_s))
                attempt += 1

    def pages(ask: Lister, provider: str) -> Iterator[tuple]:
        token, seen, number = None, {None}, 0
        while True:
            try:
                reply, token = page_of(ask, provider, token)
                yield provider, number, reply if isinstance(reply, str) else json.dumps(reply, ensure_ascii=False), None
                if token is None:
                    return
                if token in seen:
                    raise RuntimeError(f"the catalog repeats its page {token}")
            except Exception as err:  # noqa: BLE001 - any failure belongs to this provider alone
                yield provider, number, None, str(err) or type(err).__name__
                return
            seen.add(token)
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            ask = ask or lister_factory()
            for provider in batch.column(0).to_pylist():
                for row in pages(ask, provider):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)],
                        ["provider", "page", "raw", "error"],
                    )

    lanes = max(1, named.count())
    return numbered.repartitionById(lanes, F.col("_n").cast("int")).select("provider").mapInArrow(run, PAGES)
