"""Landed pages as a stream: a Python data source whose offsets are the crawl's cursor.

Pages lie in <path>/scope=<s>/lap=<l>/page=<p>/, each with JSON lines (a record a line), pages counted from 1 and laps
from 0. A micro-batch admits whole pages until it has RECORDS records, so it never has more than that and a page. The
scope with the fewest laps comes first, of those the one that is furthest. A lap ends when its next page isn't there and the
next lap's first page is. Pages are read where Spark runs their partitions: a page is one of its own, or pages are dealt to
as many as the option tasks says, so that a batch of many small pages doesn't cost a task for each.

Batches of one stream come one after the other, and most of a small batch is waiting. A large crawl is therefore dealt by scope
to streams that run side by side, each with its scopes, its cursor and its checkpoint; the order of scopes is that of a stream's own.

Pages that Spark makes are landed by tasks, which put each in place whole, with no renaming of all files by the driver at the end.

The offset says, per scope, the lap and page to read next. It is kept at <cursor>/position.json whenever Spark plans a
batch: a query that starts again goes on from the batch planned last, and one that Spark plans anew is the same
batch, so that no page is lost or read twice. Paths may be in any store that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from varve.staging import dealt

#: Records that a micro-batch admits.
RECORDS = 400
#: Records that are worth a task of their own.
TASK_RECORDS = 1000
SCHEMA = "scope string, lap int, page int, record string"
NAME = "landed_pages"


# What Spark's writers escape in the names of partition folders, beside control characters, and their name for none.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"
NONE = "__HIVE_DEFAULT_PARTITION__"


def _escaped(scope: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in scope)


def _folder(scope: str, lap: int, page: int) -> str:
    return f"scope={_escaped(scope)}/lap={lap}/page={page}"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Page(InputPartition):
    scope: str
    lap: int
    page: int
    folder: str


@dataclass
class Pages(InputPartition):
    pages: list[Page]


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.cursor = options["path"].rstrip("/"), options["cursor"].rstrip("/")
        self.records, self.tasks = int(options.get("records", RECORDS)), int(options.get("tasks", 0))
        self.scopes = set(json.loads(options["scopes"])) if "scopes" in options else None
        self.planned: dict | None = None

    def initialOffset(self) -> dict:
        return {"scopes": {}}

    def _folders(self, *parts: str) -> list[str]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector("/".join([root, *parts]), allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.Directory]

    def _files(self, page: Page) -> list[str]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{page.folder}", allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def _page(self, scope: str, lap: int, page: int) -> Page:
        return Page(scope, lap, page, _folder(scope, lap, page))

    def _lines(self, page: Page) -> Iterator[str]:
        store, _ = _store(self.path)
        for name in self._files(page):
            with store.open_input_stream(name) as f:
                for line in f.read().decode().split("\n"):
                    if line.strip():
                        yield line.removesuffix("\r")

    def _at(self) -> dict:
        """Where the batch planned last ends."""
        if self.planned is None:
            from pyarrow import fs

            store, root = _store(self.cursor)
            name = f"{root}/position.json"
            there = store.get_file_info(name).type == fs.FileType.File
            self.planned = json.loads(store.open_input_stream(name).read()) if there else self.initialOffset()
        return self.planned

    def latestOffset(self) -> dict:
        there = {unquote(s.removeprefix("scope=")) for s in self._folders() if s.startswith("scope=")}
        scopes = {s: {"lap": 0, "page": 1, "before": 0} for s in (there if self.scopes is None else there & self.scopes)}
        scopes |= {s: {**at, "before": 0} for s, at in self._at()["scopes"].items()}
        moved, done, records = set(), set(), 0
        while records < self.records and len(done) < len(scopes):
            s = min((s for s in scopes if s not in done), key=lambda s: (scopes[s]["lap"], -scopes[s]["page"], s))
            at = scopes[s]
            if not self._files(page := self._page(s, at["lap"], at["page"])):
                # a scope passes one lap's end in a batch, so that the offset can name the pages before and after it
                if at["page"] == 1 or at["before"] or not self._files(self._page(s, at["lap"] + 1, 1)):
                    done.add(s)
                else:
                    scopes[s] = {"lap": at["lap"] + 1, "page": 1, "before": at["page"]}
                continue
            records += sum(1 for _ in self._lines(page))
            scopes[s] = {**at, "page": at["page"] + 1}
            moved.add(s)
        known = self._at()["scopes"]
        return {"scopes": {s: at if s in moved else known[s] for s, at in sorted(scopes.items()) if s in moved or s in known}}

    def partitions(self, start: dict, end: dict) -> list[Page] | list[Pages]:
        pages = []
        for s, to in end["scopes"].items():
            at = start["scopes"].get(s, {"lap": 0, "page": 1})
            if (at["lap"], at["page"]) == (to["lap"], to["page"]):
                continue
            first = at["page"]
            if at["lap"] < to["lap"]:
                pages += [self._page(s, at["lap"], p) for p in range(at["page"], to["before"])]
                first = 1
            pages += [self._page(s, to["lap"], p) for p in range(first, to["page"])]
        self._keep(end)
        return [Pages(pages[k :: self.tasks]) for k in range(min(self.tasks, len(pages)))] if self.tasks else pages

    def _keep(self, end: dict) -> None:
        store, root = _store(self.cursor)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_position.json") as f:
            f.write(json.dumps(end).encode())
        store.move(f"{root}/_position.json", f"{root}/position.json")
        self.planned = end

    def read(self, partition: Page | Pages) -> Iterator[tuple]:
        for page in partition.pages if isinstance(partition, Pages) else [partition]:
            for line in self._lines(page):
                yield page.scope, page.lap, page.page, line


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def _put(rows: Iterable, path: str, run: str) -> None:
    """Rows (scope, lap, page, record), of which a page's come together, as a file a page, which a task that runs again replaces."""
    store, root = _store(path)
    task = TaskContext.get().partitionId()
    for n, ((scope, lap, page), records) in enumerate(groupby(rows, key=lambda r: (r.scope, r.lap, r.page))):
        folder, name = f"{root}/{_folder(NONE if scope is None else scope, lap, page)}", f"{run}-{task}-{n}.json"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_{name}") as f:
            f.write("".join(f"{r.record}\n" for r in records).encode())
        store.move(f"{folder}/_{name}", f"{folder}/{name}")


def _take_away(path: str, run: str) -> None:
    from pyarrow import fs

    store, root = _store(path)
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        if f.base_name.removeprefix("_").startswith(run):
            store.delete_file(f.path)


def land(pages: DataFrame, path: str) -> None:
    """Adds pages (scope, lap, page, record) to those landed at path. Those of a job that fails go again."""
    together = dealt(pages.select("scope", "lap", "page", "record"), "scope", "lap", "page").sortWithinPartitions("scope", "lap", "page")
    path, run = path.rstrip("/"), uuid.uuid4().hex
    try:
        together.foreachPartition(lambda rows: _put(rows, path, run))
    except Exception:
        _take_away(path, run)
        raise


def page_stream(spark: SparkSession, path: str, cursor: str, records: int = RECORDS, scopes: Iterable[str] | None = None) -> DataFrame:
    """scope, lap, page and record of the pages landed at path, of all scopes or of those named. A query has a cursor folder of its own,
    beside its checkpoint."""
    spark.dataSource.register(LandedPages)
    tasks = min(spark.sparkContext.defaultParallelism, -(-records // TASK_RECORDS))
    options = {"path": path, "cursor": cursor, "records": records, "tasks": tasks} | ({} if scopes is None else {"scopes": json.dumps(sorted(scopes))})
    return spark.readStream.format(NAME).options(**options).load()


def cursors(spark: SparkSession, cursor: str, store: str) -> DataFrame:
    """The cursor of a stream as rows: store_id, scope, next_page, laps."""
    scopes = F.from_json(F.get_json_object("value", "$.scopes"), "map<string,struct<lap:int,page:int>>")
    rows = spark.read.text(f"{cursor.rstrip('/')}/position.json", wholetext=True).select(F.explode(scopes).alias("scope", "at"))
    return rows.select(F.lit(store).alias("store_id"), "scope", F.col("at.page").alias("next_page"), F.col("at.lap").alias("laps"))
