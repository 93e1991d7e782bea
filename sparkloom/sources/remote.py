"""Files behind a client: framed JSON messages, and a data source that lists and reads files over them.

A message is a header of lines, of which `Content-Length` counts the bytes of the JSON body that follows an empty line; other
headers are ignored.  The data source asks `workspace/xfiles` once for the list and deals the uris to tasks, each of which reads
its files with `textDocument/xcontent` over a connection of its own.
"""

from __future__ import annotations

import json
import socket
import sys
from collections.abc import Iterator
from typing import BinaryIO

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def frame(message: dict) -> bytes:
    body = json.dumps(message, ensure_ascii=False).encode()
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


def read_message(stream: BinaryIO) -> dict | None:
    """The next message; None at the end of the stream. A missing length, or one that is not above zero, is an error."""
    length, first = None, True
    while True:
        line = stream.readline()
        if not line:
            if first:
                return None
            raise ValueError("the stream ends within a header")
        first = False
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    if length is None or length <= 0:
        raise ValueError(f"Content-Length {length} in a header")
    body = stream.read(length)
    if len(body) < length:
        raise ValueError("the stream ends within a body")
    return json.loads(body)


def messages(stream: BinaryIO) -> Iterator[dict]:
    while (message := read_message(stream)) is not None:
        yield message


class Client:
    """Requests over one connection, one after the other."""

    def __init__(self, host: str, port: int, timeout: float = 60):
        self.socket = socket.create_connection((host, port), timeout)
        self.stream, self.number = self.socket.makefile("rwb"), 0

    def request(self, method: str, params: dict):
        self.number += 1
        self.stream.write(frame({"jsonrpc": "2.0", "id": self.number, "method": method, "params": params}))
        self.stream.flush()
        for answer in messages(self.stream):
            if answer.get("id") == self.number:
                if "error" in answer:
                    raise OSError(f"{method}: {answer['error']}")
                return answer.get("result")
        raise OSError(f"{method}: the connection ended")

    def close(self) -> None:
        self.stream.close()
        self.socket.close()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class RemoteFiles(DataSource):
    """Options: host, port, base (a uri that listed files start with), files (per task, 100 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "loom_remote_files"

    def schema(self) -> str:
        return "uri string, content string"

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(self.options)


class RemotePart(InputPartition):
    def __init__(self, uris: list[str]):
        super().__init__(uris)


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.host, self.port, self.base, self.size = options["host"], int(options["port"]), options.get("base", ""), int(options.get("files", "100"))

    def partitions(self) -> list[RemotePart]:
        with Client(self.host, self.port) as client:
            uris = sorted(f["uri"] for f in client.request("workspace/xfiles", {"base": self.base}))
        return [RemotePart(uris[i : i + self.size]) for i in range(0, len(uris), self.size)] or [RemotePart([])]

    def read(self, partition: RemotePart) -> Iterator[tuple]:
        if partition.value:
            with Client(self.host, self.port) as client:
                for uri in partition.value:
                    yield uri, client.request("textDocument/xcontent", {"textDocument": {"uri": uri}})["text"]


def scan(spark: SparkSession, host: str, port: int, base: str = "", files: int = 100) -> DataFrame:
    """(uri, content, sha1) of the .php files that a client offers."""
    spark.dataSource.register(RemoteFiles)
    rows = spark.read.format("loom_remote_files").options(host=host, port=str(port), base=base, files=str(files)).load()
    content = F.encode("content", "UTF-8")
    return rows.where(F.col("uri").endswith(".php")).select("uri", content.alias("content"), F.sha1(content).alias("sha1"))
