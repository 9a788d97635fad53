"""An editor's session over JSON-RPC: open documents are scanned on every change, at once and one at a time."""

from __future__ import annotations

import json
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkquarry.plans import analysis
from sparkquarry.sources import sinks

NO_METHOD = -32601


class Editor:
    """Answers messages; handle() gives those to send back."""

    def __init__(self, spark: SparkSession, settings: analysis.Settings = analysis.Settings(profile="ide-fast")) -> None:
        self.spark, self.settings = spark, settings
        self.open: dict[str, str] = {}
        self.ended = self.shut = False

    def handle(self, message: dict) -> list[dict]:
        method, params, number = message.get("method", ""), message.get("params") or {}, message.get("id")
        document = params.get("textDocument") or {}
        uri = document.get("uri", "")
        if method == "initialize":
            return [{"jsonrpc": "2.0", "id": number, "result": {"capabilities": {"textDocumentSync": 1}, "serverInfo": {"name": "sparkquarry"}}}]
        if method == "shutdown":
            self.shut = True
            return [{"jsonrpc": "2.0", "id": number, "result": None}]
        if method == "exit":
            self.ended = True
            return []
        if method == "textDocument/didOpen":
            return self.changed(uri, document.get("text", ""))
        if method == "textDocument/didChange":
            changes = params.get("contentChanges") or []
            return self.changed(uri, changes[-1].get("text", "")) if changes else []
        if method == "textDocument/didClose":
            self.open.pop(uri, None)
            return [_published(uri, [])]
        if number is None:
            return []
        return [{"jsonrpc": "2.0", "id": number, "error": {"code": NO_METHOD, "message": f"no method {method}"}}]

    def changed(self, uri: str, text: str) -> list[dict]:
        self.open[uri] = text
        found = analysis.analyse_source(self.spark, text, uri, self.settings)
        rows = sinks.diagnostics(found.where(F.col("file_id") == uri)).collect()  # one document
        return [json.loads(r["value"]) for r in rows] or [_published(uri, [])]

    def run(self, source: BinaryIO, target: BinaryIO) -> int:
        """Serves framed messages until exit or the end of the stream; the exit code is 0 after a shutdown, else 1."""
        while not self.ended:
            message = read(source)
            if message is None:
                break
            for answer in self.handle(message):
                write(target, answer)
        return 0 if self.shut else 1


def _published(uri: str, diagnostics: list) -> dict:
    return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": diagnostics}}


def read(source: BinaryIO) -> dict | None:
    """The next message: header lines, an empty line, and as many bytes as they say."""
    size = 0
    while line := source.readline():
        text = line.strip()
        if not text:
            if size:
                return json.loads(source.read(size))
            continue
        name, _, value = text.partition(b":")
        if name.lower() == b"content-length":
            size = int(value)
    return None


def write(target: BinaryIO, message: dict) -> None:
    data = json.dumps(message).encode()
    target.write(b"Content-Length: %d\r\n\r\n" % len(data) + data)
    target.flush()
