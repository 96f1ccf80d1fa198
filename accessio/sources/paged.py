"""Searches as a data source: the pages of all terms are planned as partitions and read side by side."""

from __future__ import annotations

import io
import json
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import parse_qs, quote, urlsplit

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from accessio.sources.lookup import MOST_IDS, PAGE, Service

SCHEMA = "search_term string, place long, uid string, total long"


class Pages(InputPartition):
    """The pages (term, first place, size, total) that one task reads, and its share of the budget."""

    def __init__(self, pages: list[tuple[str, int, int, int]], start: float, task: int, tasks: int):
        self.pages, self.start, self.task, self.tasks = pages, start, task, tasks


class PagedReader(DataSourceReader):
    """Reads ids by page. Equality and membership of search_term are taken over: other terms are never asked for."""

    def __init__(self, make: Callable[[], Service], options: dict[str, str]):
        self.make = make
        self.terms = list(dict.fromkeys(json.loads(options["terms"])))
        self.db, self.page, self.most, self.tasks = options["db"], int(options["page"]), int(options["most"]), int(options["tasks"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("search_term",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("search_term",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.terms = [t for t in self.terms if t in wanted]

    def partitions(self) -> list[InputPartition]:
        """One request a term tells how many ids there are; its pages are dealt out in turn."""
        service, pages = self.make(), []
        for term in self.terms:
            total, _ = service.part_of_search(term, self.db, 0, 0)
            ends = min(total, self.most)
            pages += [(term, at, min(self.page, self.most - at), total) for at in range(0, ends, self.page)]
        tasks, start = max(1, min(self.tasks, len(pages))), time.time()
        return [Pages(pages[k::tasks], start, k, tasks) for k in range(tasks)]

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str, int]]:
        service = self.make()
        service.share(partition.start, partition.task, partition.tasks)
        for term, at, size, total in partition.pages:
            for k, uid in enumerate(service.part_of_search(term, self.db, at, size)[1]):
                yield term, at + k, uid, total


def paged_search(spark: SparkSession, make: Callable[[], Service], terms: list[str], db: str = "biosample", page: int = PAGE, most: int = MOST_IDS, tasks: int = 8) -> DataFrame:
    """search_term, place, uid, total: the first `most` ids of each term, each once, a page a request, in up to `tasks` tasks.

    make() gives a service in any process; its delay is the budget of all tasks
    together. The driver plans the pages, so terms is a list that it holds; a table of
    specs goes through HttpLookup. This turns on the session's
    spark.sql.python.filterPushdown.enabled, without which Spark refuses a source that takes filters.
    """

    class PagedSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_search"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: Any) -> PagedReader:
            return PagedReader(make, self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    return spark.read.format("paged_search").options(terms=json.dumps(terms), db=db, page=page, most=most, tasks=tasks).load()


# Recorded answers ----------------------------------------------------------------------------------

BUCKET_BITS, GROUP_BYTES, GROUPS_HELD = 4, 1 << 20, 4


def search_request(db: Column, term: Column, start: Column, size: Column) -> Column:
    """The key of a search's recorded answer."""
    return F.concat_ws("|", F.lit("esearch"), db, term, start.cast("string"), size.cast("string"))


def summary_request(db: Column, ids: Column) -> Column:
    return F.concat_ws("|", F.lit("esummary"), db, ids)


def record_answers(answers: DataFrame, folder: str, near: str | None = None) -> None:
    """Keeps (request, answer) rows, answers as JSON texts, in order of a hash of the request, or of the column `near`.

    near: the term of a search, for its pages and for the summaries of their ids, which
    are asked for one after another. Files have small row groups, of which a reader
    takes the one at hand.
    """
    by = "by_term" if near else "by_request"
    rows = answers.select("request", "answer", F.crc32(F.col(near or "request").cast("binary")).alias(by)).withColumn("bucket", F.shiftright(by, 32 - BUCKET_BITS).cast("int"))
    rows.repartition(1 << BUCKET_BITS, "bucket").sortWithinPartitions("bucket", by).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(folder)


class _Group:
    """A row group of recorded answers and the hashes that it begins and ends with."""

    def __init__(self, file: pq.ParquetFile, number: int):
        self.file, self.number = file, number
        self.by = next(c for c in file.schema_arrow.names if c.startswith("by_"))
        seen = file.metadata.row_group(number).column(file.schema_arrow.names.index(self.by)).statistics
        self.low, self.high = seen.min, seen.max

    def answers(self) -> dict[str, str]:
        found = self.file.read_row_group(self.number, columns=["request", "answer"])
        return dict(zip(found["request"].to_pylist(), found["answer"].to_pylist(), strict=True))


class Recorded:
    """An opener for Service that answers from a folder of record_answers, which workers must reach; a request without an answer fails.

    It holds a few row groups, whatever the folder's size; requests in the order of
    their terms' hashes, as HttpLookup has them, read each once.
    """

    def __init__(self, folder: str):
        self.folder, self.term = folder, None
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(quote(folder, safe=":/")) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        self.groups: dict[int, list[_Group]] = {}
        self.held: dict[_Group, dict[str, str]] = {}

    def _groups(self, bucket: int) -> list[_Group]:
        if bucket not in self.groups:
            files = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/bucket={bucket}", allow_not_found=True))
            opened = [pq.ParquetFile(self.fs.open_input_file(f.path)) for f in files if f.base_name.endswith(".parquet")]
            self.groups[bucket] = [_Group(f, i) for f in opened for i in range(f.num_row_groups)]
        return self.groups[bucket]

    def _answers(self, group: _Group) -> dict[str, str]:
        if group not in self.held:
            if len(self.held) >= GROUPS_HELD:
                del self.held[next(iter(self.held))]  # the one held longest
            self.held[group] = group.answers()
        return self.held[group]

    def _places(self, request: str, summary: bool) -> Iterator[_Group]:
        """The row groups where the answer can stand."""
        for by, place in (("by_term", self.term), ("by_request", zlib.crc32(request.encode()))):
            if place is not None:
                yield from (g for g in self._groups(place >> 32 - BUCKET_BITS) if g.by == by and g.low <= place <= g.high)
        if summary:  # of another search's ids than the last one's
            yield from (g for bucket in range(1 << BUCKET_BITS) for g in self._groups(bucket) if g.by == "by_term")

    def __call__(self, address: str, timeout: float) -> io.BytesIO:
        parts = urlsplit(address)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        summary = "esearch" not in parts.path
        if summary:
            request = "|".join(("esummary", q["db"], q["id"]))
        else:
            request, self.term = "|".join(("esearch", q["db"], q["term"], q["retstart"], q["retmax"])), zlib.crc32(q["term"].encode())
        for group in self._places(request, summary):
            answer = self._answers(group).get(request)
            if answer is not None:
                return io.BytesIO(answer.encode("utf-8"))
        raise OSError(f"no answer for {request}")
