"""Addresses fetched as a data source: spark.read.format("pagegrain_web").option("urls", JSON list of addresses).

A partition holds a stretch of the address list, so fetching spreads over executors and a lost one repeats only
its own. Status and errors are columns: a failing address never fails the job.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, TIMEOUT, PAUSE = 8_000_000, 20, 0.4
AGENT = "pagegrain/1 (+batch reader)"
_DDL = "url string, final_url string, status int, ctype string, content binary, error string"


def explained(e: Exception) -> str:
    """What went wrong, in a reader's words."""
    why = getattr(e, "reason", e)
    if isinstance(why, TimeoutError):
        return "timed out (the site is slow or unreachable)"
    if isinstance(why, ConnectionRefusedError):
        return "connection refused (is the server running?)"
    if "certificate" in str(why):
        return f"the TLS certificate is not valid: {why}"
    if type(why).__name__ == "gaierror":
        return "no such host (check the address)"
    return str(why)


def fetch(url: str, languages: str = "en") -> tuple:
    """A row of the source. A timeout or a cut connection gets one more try."""
    for last in (False, True):
        try:
            asked = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": languages})
            with urllib.request.urlopen(asked, timeout=TIMEOUT) as r:
                kind = r.headers.get("Content-Type", "")
                name = kind.split(";")[0].strip().lower()
                if name and not name.startswith("text/") and "json" not in name and "xml" not in name:
                    return url, r.url, r.status, kind, None, f"unsupported type {name}"
                return url, r.url, r.status, kind, r.read(MAX_BYTES), None
        except urllib.error.HTTPError as e:
            return url, e.url, e.code, e.headers.get("Content-Type", ""), e.read(64 << 10), f"status {e.code}"
        except (OSError, ValueError, http.client.HTTPException) as e:
            why = getattr(e, "reason", e)
            if last or not isinstance(why, (TimeoutError, ConnectionResetError, ConnectionAbortedError)):
                return url, None, None, None, None, explained(e)
            time.sleep(PAUSE)
    raise AssertionError


class _Stretch(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])
        self.languages = options.get("languages", "en")
        self.n = max(1, int(options.get("partitions", "8")))

    def partitions(self):
        return [_Stretch(self.urls[k :: self.n]) for k in range(min(self.n, max(1, len(self.urls))))]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.languages)


class WebSource(DataSource):
    """Options: urls (a JSON list), partitions, languages."""

    @classmethod
    def name(cls) -> str:
        return "pagegrain_web"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def web_pages(spark: SparkSession, urls: list[str], partitions: int = 8) -> DataFrame:
    """(url, final_url, status, ctype, content, error) of a list of addresses."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(WebSource)
    return spark.read.format("pagegrain_web").option("urls", json.dumps(urls)).option("partitions", str(partitions)).load()


def fetched(addresses: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same for a table of addresses (url) of any size: each distinct one is fetched once, where its row is."""
    from ..session import ship

    ship(addresses.sparkSession)
    one = addresses.select("url").where("url is not null").distinct()
    one = one.repartition(partitions, "url") if partitions else one

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("ctype", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for url in batch.column(0).to_pylist():  # a row a batch: a page may be large
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, fetch(url), strict=True))], schema=schema)

    return one.mapInArrow(run, _DDL)
