"""Raw corpora as a data source of Spark: spark.read.format("veerline").option("kind", ...).load(root), and the same as a sink.

A document is a file below the root (or, for corpora of JSON lines, a line of one). What a kind's paths say (pipeline, submission, model and so on) are
columns, and options of the same names select by them: files that they rule out are never opened. Files are dealt to partitions by their
bytes. Written, each row of rel and text becomes a file.

The selection comes by options, not by pushFilters(): Spark 4.1.2 keeps what a filter left of a Python source with the table, so that another query on the same
DataFrame reads with the first one's filters (a union of two selections gave rows of one). Spark's own reader, files.documents(), prunes by any filter on its paths.

Paths are opened by Arrow's file systems (local or mounted folders, and those that it has drivers for). For all other stores there is files.documents(), by Spark's own readers."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Paths below the root of each kind; named groups are columns. Kinds of lines hold a document a line.
PATHS = {
    "injection": r"(?P<pipeline>[^/]+)/.+\.json",
    "coding": r"(?P<submission>[^/]+)/trajs/(?P<file>[^/]+\.(?:traj|json))",
    "terminal": r"(?P<task>[^/]+)/(?P<model_dir>[^/]+)/(?P<tree>baseline_trajectories|hack_trajectories)/(?P<label>[^/]+)/(?:metadata|trial/agent/trajectory)\.json",
    "exported": r".+\.jsonl",
    "spans": r"(?P<run>.+)\.json",
    "blamed": r"(?P<run>.+)\.json",
    "chat": r".+\.jsonl",
    "hallucination": r"(?P<directory>[^/]+)/.+\.json",
    "documents": r".+",
}
LINES = ("exported", "chat")
#: Bytes and files of a partition; characters of texts that are handed over at once.
PARTITION_BYTES, PARTITION_FILES, AT_ONCE = 32 << 20, 2000, 8 << 20
#: Setting of the bytes that Spark hands to a Python worker at once; rows are whole documents, so AT_ONCE holds for them too.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", root))
    else:
        system, path = fs.LocalFileSystem(), root
    return system, path.rstrip("/")


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.root = options.get("kind", "documents"), options["path"]
        self.path = re.compile(PATHS[self.kind])
        self.only = {c: set(json.loads(options[c])) for c in self.path.groupindex if options.get(c)}

    def _fits(self, rel: str) -> bool:
        m = self.path.fullmatch(rel)
        return m is not None and all(m[c] in values for c, values in self.only.items())

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.root)
        out, names, size = [], [], 0
        found = [(x.path[len(root) + 1 :], x.size or 0) for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
        for rel, n in sorted(found):
            if not self._fits(rel):
                continue
            if names and (size + n > PARTITION_BYTES or len(names) >= PARTITION_FILES):
                out.append(Files(names))
                names, size = [], 0
            names.append(rel)
            size += n
        return [*out, Files(names)] if names or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        columns = list(self.path.groupindex)
        schema = pa.schema([(c, pa.string()) for c in columns] + [("rel", pa.string()), *([("line", pa.int64())] if self.kind in LINES else []), ("text", pa.string())])
        rows, held = [], 0
        for rel in partition.names:
            parts = {"rel": rel} | {c: self.path.fullmatch(rel)[c] for c in columns}
            with system.open_input_stream(f"{root}/{rel}") as f:
                if self.kind in LINES:
                    import io

                    texts = enumerate(line.rstrip("\r\n") for line in io.TextIOWrapper(f, "utf-8", "replace", newline="\n"))
                else:
                    texts = [(None, f.read().decode("utf-8", "replace"))]
                for line, text in texts:
                    rows.append(parts | {"text": text} | ({} if line is None else {"line": line}))
                    held += len(text)
                    if held > AT_ONCE or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema):
        self.root = options["path"]
        if not {"rel", "text"} <= set(schema.fieldNames()):
            raise ValueError("documents are written from columns rel and text")

    def write(self, rows) -> WriterCommitMessage:
        """A task that is run again writes the same files."""
        system, root = opened(self.root)
        known: set[str] = set()
        for row in rows:
            parts = row["rel"].split("/")
            if "" in parts or ".." in parts or "." in parts:
                raise ValueError(f"not a path below the root: {row['rel']}")
            folder = "/".join([root, *parts[:-1]])
            if folder not in known:
                system.create_dir(folder, recursive=True)
                known.add(folder)
            with system.open_output_stream(f"{root}/{row['rel']}") as f:
                f.write((row["text"] or "").encode())
        return WriterCommitMessage()


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veerline"

    def schema(self) -> str:
        kind = self.options.get("kind", "documents")
        if kind not in PATHS:
            raise ValueError(f"kind is one of {', '.join(sorted(PATHS))}")
        return ", ".join([*(f"{c} string" for c in re.compile(PATHS[kind]).groupindex), "rel string", *(["line long"] if kind in LINES else []), "text string"])

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds the batches of the jobs within to AT_ONCE bytes, or fewer where the session says so."""
    before = spark.conf.get(BATCH_BYTES)
    size = int(before.rstrip("b")) if before.rstrip("b").lstrip("-").isdigit() else 0
    if not 0 < size <= AT_ONCE:
        spark.conf.set(BATCH_BYTES, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def corpus(spark: SparkSession, kind: str, root: str, **only: list[str]):
    """The documents of a corpus, with the columns that its paths give; only: the values of such columns that are wanted."""
    if unknown := set(only) - set(re.compile(PATHS[kind]).groupindex):
        raise ValueError(f"paths of {kind} don't tell {', '.join(sorted(unknown))}")
    spark.dataSource.register(Documents)
    return spark.read.format("veerline").option("kind", kind).options(**{c: json.dumps(list(v)) for c, v in only.items()}).load(root)


def write_documents(df, root: str) -> None:
    """Each row of df (rel, text) as a file below root."""
    df.sparkSession.dataSource.register(Documents)
    with small_batches(df.sparkSession):
        df.select("rel", "text").write.format("veerline").mode("append").save(root)
