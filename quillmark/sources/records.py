"""Data sources over text files of records: spark.read.format("register_text") and ("rejection_text") of a folder.

Files are split by byte ranges. A record belongs to the range in which it begins, so a reader looks for the first beginning at
or after the range's start and goes on until one lies beyond its end, however the ranges are cut. Equality and membership of
the code are evaluated in the reader, before a row becomes one of Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from quillmark.functions.text import REGISTER_ROW

#: Bytes of a range, and of a read.
RANGE, READ = 16 << 20, 1 << 20
PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Part(InputPartition):
    path: str
    tenant: str | None
    number: int
    start: int
    end: int


def _lines(path: str, start: int, end: int, begins: re.Pattern | None) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that begin within start and end; a record is a line, or goes on to the next line that matches `begins`."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        at = max(0, start - 1)
        f.seek(at)
        rest, first, held = b"", start > 0, None  # the byte before the range tells whether a line begins with it
        while True:
            data = f.read(READ)
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            for line in lines:
                here, at = at, at + len(line) + 1
                if first:
                    first = False
                    continue
                if begins is None:
                    if here >= end:
                        return
                    yield here, line
                elif begins.match(line):
                    if held:
                        yield held[0], b"\n".join(held[1])
                        held = None
                    if here >= end:
                        return
                    held = (here, [line])
                elif held:
                    held[1].append(line)
            if not data:
                if held:
                    yield held[0], b"\n".join(held[1])
                return


class Records(DataSourceReader):
    """Rows of the records that `row` makes something of: it gets the text and gives the values after tenant_id and pos, code first."""

    begins: re.Pattern | None = None

    def __init__(self, path: str, size: int):
        self.path, self.size, self.codes = path, size, None

    def row(self, text: str) -> tuple | None:
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("code",):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = these if self.codes is None else self.codes & these
            elif not (isinstance(f, IsNotNull) and f.attribute == ("code",)):  # a row has a code
                yield f

    def partitions(self) -> list[Part]:
        fs, name = pafs.FileSystem.from_uri(self.path)
        infos = fs.get_file_info(pafs.FileSelector(name, recursive=True))
        files = sorted((i for i in infos if i.is_file and i.size and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        base = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else self.path.split(":", 1)[0] + "://"
        tenant = lambda p: (m := re.search(r"/tenant_id=([^/]+)/", p)) and m[1]
        return [Part(base + i.path, tenant(i.path), n, a, min(a + self.size, i.size)) for n, i in enumerate(files) for a in range(0, i.size, self.size)] or [Part("", None, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        for at, record in _lines(partition.path, partition.start, partition.end, self.begins):
            found = self.row(record.decode("utf-8", "replace"))
            if found and (self.codes is None or found[0] in self.codes):
                yield partition.tenant, (partition.number << 42) + at, *found


class RegisterReader(Records):
    pattern = re.compile(REGISTER_ROW, re.ASCII)

    def row(self, text: str) -> tuple | None:
        m = self.pattern.search(text.rstrip())
        return m and m.groups()


class RejectionReader(Records):
    #: The lines of an entry of a rejection report.
    begins = re.compile(rb"- \*\*")
    pattern = re.compile(r"- \*\*([^ ]+) §([^*]+)\*\* — ([A-Z0-9, -]+?)\s*\n\s*- P: (.+?)\n\s*- R: ([^\n]+)")

    def row(self, text: str) -> tuple | None:
        if not (m := self.pattern.match(text)):
            return None
        code, section, phantoms, question, answer = m.groups()
        return code, section.strip(" "), ",".join(p.strip(" ") for p in phantoms.split(",")), question.strip(" "), answer.strip(" ")


class RegisterText(DataSource):
    """tenant_id, pos, code, version, effective_date as they stand in a register's lines; tenant_id is that of a folder tenant_id=..."""

    reader_type, columns = RegisterReader, "code string, version string, effective_date string"

    @classmethod
    def name(cls) -> str:
        return "register_text"

    def schema(self) -> str:
        return f"tenant_id string, pos long, {self.columns}"

    def reader(self, schema) -> Records:
        return self.reader_type(self.options["path"], int(self.options.get("rangebytes", RANGE)))


class RejectionText(RegisterText):
    """tenant_id, pos, code, section, phantoms, question, answer of the entries of rejection reports."""

    reader_type, columns = RejectionReader, "code string, section string, phantoms string, question string, answer string"

    @classmethod
    def name(cls) -> str:
        return "rejection_text"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, which passes filters to them."""
    spark.conf.set(PUSHED, "true")
    for source in (RegisterText, RejectionText):
        spark.dataSource.register(source)
