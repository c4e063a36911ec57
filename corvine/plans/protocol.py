"""The tools over JSON-RPC: one message a line, one answer a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

VERSION = "2024-11-05"
#: Error codes of JSON-RPC (fixed values).
PARSE, INVALID, UNKNOWN, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

_TEXT, _INT, _TEXTS = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}
#: Arguments and required ones of every tool (T-7).
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "search_code": ("Chunks nearest to a text", {"query": _TEXT, "limit": _INT}, ["query"]),
    "search_symbol": ("Chunks by symbol name", {"name": _TEXT, "kind": _TEXT}, ["name"]),
    "get_context": ("Chunks near a line and related ones", {"file": _TEXT, "line": _INT, "radius": _INT}, ["file"]),
    "get_session_memory": ("Saved sessions by words", {"query": _TEXT}, []),
    "save_session_summary": ("Save a session", {"summary": _TEXT, "key_files": _TEXTS, "key_decisions": _TEXTS}, ["summary"]),
}


def kind(message: Any) -> str:
    """F15."""
    if not isinstance(message, dict) or not isinstance(message.get("method", ""), str):
        return "INVALID"
    if "method" in message:
        return "REQUEST" if "id" in message else "NOTIFICATION"
    return "RESPONSE" if "id" in message else "INVALID"


class Server:
    def __init__(self, name: str = "corvine"):
        self.name, self.handlers = name, {}

    def register(self, tool: str, handler: Callable[[dict], Any]) -> None:
        self.handlers[tool] = handler

    def handle(self, line: str) -> dict | None:
        """The answer to one message; None where none is due."""
        try:
            message = json.loads(line)
        except ValueError:
            return self._error(None, PARSE, "not JSON")
        what = kind(message)
        own = message.get("id") if isinstance(message, dict) else None
        if what in ("INVALID", "RESPONSE"):
            return self._error(own, INVALID, "not a request")
        method, params = message["method"], message.get("params") or {}
        if method == "initialize":
            return self._result(own, {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1.0"}})
        if method == "tools/list":
            return self._result(own, {"tools": [{"name": n, "description": TOOLS[n][0], "inputSchema": {"type": "object", "properties": TOOLS[n][1], "required": TOOLS[n][2]}} for n in self.handlers]})
        if method == "tools/call":
            return self._call(own, params)
        if what == "NOTIFICATION":
            return None
        return self._error(own, UNKNOWN, f"no method {method}")

    def _call(self, own: Any, params: dict) -> dict:
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            return self._error(own, PARAMS, "a tool's name is needed")
        if params["name"] not in self.handlers:
            return self._error(own, UNKNOWN, f"no tool {params['name']}")
        arguments = params.get("arguments") or {}
        missing = [x for x in TOOLS[params["name"]][2] if not arguments.get(x)]
        if missing:
            found: Any = {"error": f"missing: {', '.join(missing)}", "results": []}
        else:
            try:
                found = self.handlers[params["name"]](arguments)
            except Exception as e:  # a tool's failure is its caller's answer
                return self._error(own, INTERNAL, str(e)[:500])
        return self._result(own, {"content": [{"type": "text", "text": json.dumps(found, default=str)}]})

    @staticmethod
    def _result(own: Any, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": own, "result": result}

    @staticmethod
    def _error(own: Any, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": own, "error": {"code": code, "message": text}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        """Until the source ends. A ``Content-Length`` header frames the
        message after it."""
        while line := source.readline():
            line = line.strip()
            if line.lower().startswith("content-length:"):
                size = int(line.partition(":")[2])
                while source.readline().strip():
                    pass
                line = source.read(size)
            if line and (answer := self.handle(line)) is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
