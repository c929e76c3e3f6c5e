"""Export to the JSON document store that ``legacy`` imports: a Python data source with a writer.

Each task writes one file, a document store of its own (table name to
{number: document}, indented by two), into a staging folder; the commit moves
all of them into place, an abort removes the folder, so a job that fails leaves
no file.  With the option ``single`` the commit joins the tasks' documents into
one store, a document at a time; that is one stream through the driver, for
libraries that a single file can hold.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROW = "number long, document string"


def iso(t: Column) -> Column:
    """Text of a time as ``datetime.isoformat`` writes it: a fraction only where there is one."""
    micros = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))


def documents(library: DataFrame) -> DataFrame:
    """(number, JSON text) of library rows."""
    exif = F.col("exif").withField("captured_at", iso(F.col("exif.captured_at")))
    body = F.struct("file_hash", "file_info", "dimensions", exif.alias("exif"), "labels", iso(F.col("added_at")).alias("added_at"))
    return library.select(F.col("doc_id").alias("number"), F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _entry(number: int, document: str) -> str:
    body = json.dumps(json.loads(document), indent=2).replace("\n", "\n    ")
    return f'    "{number}": {body}'


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.table = options["path"].rstrip("/"), options.get("table", "metadata")
        self.single, self.overwrite = options.get("single", "false").lower() == "true", overwrite
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        """One task: documents as they come, none held."""
        name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.json", 0
        store, staging = _place(self.staging)
        store.create_dir(staging, recursive=True)
        with store.open_output_stream(f"{staging}/{name}") as out:
            out.write(f"{{\n  {json.dumps(self.table)}: {{\n".encode())
            for row in iterator:
                out.write(((",\n" if rows else "") + _entry(row.number, row.document)).encode())
                rows += 1
            out.write(b"\n  }\n}\n")
        return Written(name, rows)

    def commit(self, messages):
        store, base = _place(self.path)
        staging = _place(self.staging)[1]
        done = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        from pyarrow import fs

        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".json"):
                    store.delete_file(f.path)
        if self.single:
            name, first = f"store-{uuid.uuid4().hex[:8]}.json", True
            with store.open_output_stream(f"{staging}/{name}") as out:
                out.write(f"{{\n  {json.dumps(self.table)}: {{\n".encode())
                for m in done:
                    if m.rows:
                        with store.open_input_stream(f"{staging}/{m.name}") as f:
                            self._joined(f, out, first)
                        first = False
                out.write(b"\n  }\n}\n")
            store.move(f"{staging}/{name}", f"{base}/{name}")
        else:
            for m in done:
                store.move(f"{staging}/{m.name}", f"{base}/{m.name}")
        store.delete_dir(staging)

    @staticmethod
    def _joined(source, out, first: bool) -> None:
        """Copy the documents of one store, without its first and last two lines."""
        import io

        held: list[bytes] = []
        for i, line in enumerate(io.BufferedReader(source)):
            if i < 2:
                continue
            held.append(line)
            if len(held) > 2:
                now = held.pop(0)
                out.write((b"" if first else b",\n") + now.rstrip(b"\n") if i == 4 else b"\n" + now.rstrip(b"\n"))

    def abort(self, messages):
        from pyarrow import fs

        store, staging = _place(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class JsonStore(DataSource):
    """``df.write.format("json_store").save(folder)``; options ``table`` and ``single``."""

    @classmethod
    def name(cls):
        return "json_store"

    def schema(self):
        return ROW

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def export(library: DataFrame, folder: str, table: str = "metadata", single: bool = False) -> None:
    """Write library rows as a document store in ``folder``, in place of the one there."""
    library.sparkSession.dataSource.register(JsonStore)
    documents(library).write.format("json_store").option("table", table).option("single", str(single).lower()).mode("overwrite").save(folder)
