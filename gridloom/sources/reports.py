"""SNK1, SNK2 as a sink that commits: reports' files appear all at once, or not at all.

A task writes its rows' files to a folder of its own below a hidden one; when all tasks are done, each folder that a task
reported is moved into place by one rename. A task that dies, or is tried again, leaves what it wrote in the hidden folder,
which goes with the commit or the abort."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .documents import markdown
from .ranges import opened

FORMAT = "gridloom_reports"
#: A file's name, without a folder, and its text.
FILES = "name string, content string"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def _there(self) -> tuple[pafs.FileSystem, str]:
        fs, path = opened(self.path)
        return fs, path

    def write(self, batches: Iterator) -> Written:
        fs, path = self._there()
        # Another try of the same task has a folder of its own.
        folder, n = f"part-{uuid.uuid4().hex}", 0
        at = f"{path}/{self.hidden}/{folder}"
        for b in batches:
            if b.num_rows and not n:
                fs.create_dir(at)
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"{name!r} is no file's name")
                with fs.open_output_stream(f"{at}/{name}") as out:
                    out.write((content or "").encode())
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = self._there()
        fs.create_dir(path)
        for m in messages:
            if m is not None and m.files:
                fs.move(f"{path}/{self.hidden}/{m.folder}", f"{path}/{m.folder}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, path = self._there()
        if fs.get_file_info(f"{path}/{self.hidden}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.hidden}")


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("reports are added, never written over")
        return ReportWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Rows of FILES as files below path, in a folder a task."""
    files.sparkSession.dataSource.register(Reports)
    files.select("name", "content").write.format(FORMAT).mode("append").save(path)


def _named(request: Column, ending: str) -> Column:
    return F.concat(F.lit("report-"), F.regexp_replace(request.cast("string"), "[^A-Za-z0-9-]", "_"), F.lit(ending))


def write_json_reports(reports: DataFrame, path: str) -> None:
    """SNK1: each report (see evidence.full_report) as a JSON file of its own."""
    write_files(reports.select(_named(F.col("request"), ".json").alias("name"), F.to_json(F.struct(*reports.columns)).alias("content")), path)


def write_markdown_reports(reports: DataFrame, path: str) -> None:
    """SNK2: each report (see evidence.full_report) as a Markdown file of its own; a fallback says what went wrong."""
    flat = reports.select(
        "request", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("consistency.status", F.lit("failed")).alias("status"),
        F.coalesce("confidence.score", F.lit(0.0)).alias("confidence"), F.coalesce("confidence.tier", F.lit("UNSUPPORTED")).alias("tier"), "findings",
    )
    write_files(markdown(flat, "request").select(_named(F.col("request"), ".md").alias("name"), F.col("value").alias("content")), path)
