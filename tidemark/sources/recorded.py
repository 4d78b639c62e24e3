"""Recorded vendor responses as a data source, for batches and streams.

    spark.dataSource.register(RecordedResponses)
    spark.read.format("recorded_responses").option("path", folder).load()

A folder holds JSON lines, one response a line, in ``account=<name>/*.json``, or those of many
accounts in ``accounts=<k>-of-<n>/*.json`` (see ``write``), where each line names its account
and k is the account's CRC-32 modulo n.  Accounts, or such groups, are the partitions: a large
one, beyond the option ``partitionBytes``, is several, and beyond ``APART`` of them small ones
share one.  A filter on the account is answered by listing, so the files of other accounts, or of
other groups, are never opened.  A stream reads files called ``page-<number>.json``, page after
page; all files of a page are there once one of them is.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = (
    "account string, job_id long, attempt int, vendor string, fetched_at double, outcome string, retry_after double, "
    "posts array<struct<platform_post_id:string,views:long,likes:long,comments:long,shares:long,published_at:string>>"
)
POST = pa.struct([("platform_post_id", pa.string()), *[(m, pa.int64()) for m in ("views", "likes", "comments", "shares")], ("published_at", pa.string())])
COLUMNS = [("account", pa.string()), ("job_id", pa.int64()), ("attempt", pa.int32()), ("vendor", pa.string()), ("fetched_at", pa.float64()), ("outcome", pa.string()), ("retry_after", pa.float64()), ("posts", pa.list_(POST))]
#: Files that one task reads one after the other, and responses of one batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 2_000
#: So many accounts or groups have partitions of their own; where there are more, opening a file counts as so many bytes.
APART, OPEN_BYTES = 256, 64 << 10
#: Responses that ``write`` gives a group of accounts.
GROUP_ROWS = 20_000


@dataclass(frozen=True, order=True)
class File:
    """A file of one account, or of the group ``k`` of ``n`` (n is 0 for a single account)."""

    account: str
    n: int
    k: int
    path: str
    size: int

    def holds(self, account: str) -> bool:
        return zlib.crc32(account.encode()) % self.n == self.k if self.n else account == self.account


class Files(InputPartition):
    """Some files; with ``named``, only these accounts of those that are a group's."""

    def __init__(self, files: list[File], named: frozenset[str] | None = None):
        super().__init__(tuple(files))
        self.files, self.named = files, named


def _listed(path: str) -> list[File]:
    """All recorded files, in a fixed order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        at = re.search(r"(?:^|/)(?:account=([^/]*)|accounts=(\d+)-of-(\d+))/[^/._][^/]*\.json$", info.path)
        if info.is_file and at:
            found.append(File(unquote(at[1] or ""), int(at[3] or 0), int(at[2] or 0), info.path, info.size))
    return sorted(found)


def _dealt(files: Iterable[File], most: int, named: frozenset[str] | None = None) -> list[InputPartition]:
    """Partitions of ``most`` bytes, or one file; small accounts share one where there are very many."""
    files = [f for f in files if named is None or any(map(f.holds, named))]
    shared = len({(f.account, f.n, f.k) for f in files}) > APART
    parts: list[list[File]] = []
    total = 0
    for f in files:
        weight = f.size + (OPEN_BYTES if shared else 0)
        last = parts[-1][-1] if parts else None
        if last is None or total + weight > most or not (shared or (f.account, f.n, f.k) == (last.account, last.n, last.k)):
            parts.append([])
            total = 0
        parts[-1].append(f)
        total += weight
    return [Files(own, named and frozenset(a for a in named if any(f.holds(a) for f in own))) for own in parts]


def _outcome(r: dict) -> str:
    """What was recorded, else complete or partial by is_complete."""
    return r.get("outcome") or ("complete" if r.get("is_complete") else "partial")


def _responses(path: str, part: Files) -> Iterator[pa.RecordBatch]:
    """A partition's responses; only complete ones keep their posts, and a line that isn't JSON is reported as such."""
    from pyarrow import fs

    system = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in COLUMNS], names=[c for c, _ in COLUMNS])

    for file in part.files:
        with system.open_input_stream(file.path) as f:
            text = f.read().decode()
        for line in text.splitlines():
            if not line.strip():
                continue
            try:
                r = json.loads(line)
            except ValueError:
                r = {"outcome": "unreadable"}
            account = r.get("account") if file.n else file.account
            if file.n and part.named is not None and account not in part.named:
                continue
            kind = _outcome(r)
            posts = [{c.name: p.get(c.name) for c in POST} for p in r.get("posts") or []] if kind == "complete" else []
            rows.append({**r, "account": account, "outcome": kind, "posts": posts})
            if len(rows) == BATCH_ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


class Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.accounts = path, most, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters that name accounts; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("account",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.accounts = named if self.accounts is None else self.accounts & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return _dealt(_listed(self.path), self.most, None if self.accounts is None else frozenset(self.accounts))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        # without partitions Spark asks for None
        return _responses(self.path, partition) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    """Offsets are page numbers: a batch has the pages from one to the next."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    @staticmethod
    def _page(name: str) -> int:
        at = re.search(r"/page-([0-9]+)\.json$", name)
        return int(at[1]) if at else -1

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max((self._page(f.path) for f in _listed(self.path)), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt((f for f in _listed(self.path) if start["page"] <= self._page(f.path) < end["page"]), self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _responses(self.path, partition) if partition is not None else iter(())

    def commit(self, end: dict) -> None:
        """Recorded files stay."""


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._most())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], self._most())

    def _most(self) -> int:
        return int(self.options.get("partitionbytes", PARTITION_BYTES))


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedResponses)


def write(responses: DataFrame, folder: str, rows: int = GROUP_ROWS) -> None:
    """Responses with their column account as JSON lines in groups of accounts, about ``rows`` responses each.

    The files grow in number with the responses, not with the accounts; a group beyond a task's share is written by several.
    """
    n = max(1, math.ceil(responses.count() / rows))
    k = F.coalesce(F.pmod(F.crc32(F.col("account").cast("binary")), F.lit(n)), F.lit(0))
    grouped = responses.withColumn("accounts", F.concat(k.cast("string"), F.lit(f"-of-{n}")))
    grouped.hint("rebalance", "accounts").write.partitionBy("accounts").option("maxRecordsPerFile", 100_000).json(folder)
