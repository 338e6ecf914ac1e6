"""A tool server: JSON-RPC, a message a line, over two streams.

The tools' names and arguments are fixed values of the protocol that clients know."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Protocol, TextIO

from ..operators.asking import Options
from ..operators.ranking import rendered
from .engine import Engine

PROTOCOL = "2025-06-18"
START_FILES = 3000
NO_METHOD, BAD_PARAMS, BAD_REQUEST, NOT_JSON = -32601, -32602, -32600, -32700
TEXT, FLAG = {"type": "string"}, {"type": "boolean"}
TOOLS = [
    {
        "name": "where_next",
        "description": "Up to three files of this repository that may be worth opening next for a task in words. Hints only come with state ok; in any other state search as usual.",
        "inputSchema": {"type": "object", "properties": {"query": TEXT, "context": TEXT, "start": FLAG}, "required": ["query"]},
    },
    {"name": "refresh_index", "description": "Reads new and changed files into the index now.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "status", "description": "State and size of the index, the model and the adapter.", "inputSchema": {"type": "object", "properties": {}}},
]


class Service(Protocol):
    """What the tools call; a repository's engine, or a stand-in."""

    def ask(self, query: str, context: str, start: bool) -> dict: ...
    def refresh(self) -> dict: ...
    def status(self) -> dict: ...


class RepositoryService:
    def __init__(self, engine: Engine, root: str):
        self.engine, self.root = engine, root

    def ask(self, query: str, context: str, start: bool) -> dict:
        answer = self.engine.ask_one(self.root, query, context, Options(start_min_files=START_FILES if start else None))
        return {k: answer[k] for k in ("state", "reason", "fallback", "adapter", "revision", "hints")}

    def refresh(self) -> dict:
        return self.engine.refresh(self.root)

    def status(self) -> dict:
        return self.engine.status(self.root)


class Refused(Exception):
    def __init__(self, code: int, message: str):
        self.code, self.message = code, message


def called(service: Service, name: str, given: dict) -> dict:
    """The result of a tool; wrong arguments are refused, failures of the service are results of state error."""
    tool = next((t for t in TOOLS if t["name"] == name), None)
    if tool is None:
        raise Refused(BAD_PARAMS, f"no tool {name}")
    if not isinstance(given, dict):
        raise Refused(BAD_PARAMS, "arguments must be an object")
    schema = tool["inputSchema"]
    for k in schema.get("required", ()):
        if k not in given:
            raise Refused(BAD_PARAMS, f"{k} is missing")
    for k, v in given.items():
        kind = schema["properties"].get(k, {}).get("type")
        if v is not None and ((kind == "string" and not isinstance(v, str)) or (kind == "boolean" and not isinstance(v, bool))):
            raise Refused(BAD_PARAMS, f"{k} must be a {kind}")
    run: dict[str, Callable[[], dict]] = {
        "where_next": lambda: service.ask(given["query"] or "", given.get("context") or "", bool(given.get("start"))),
        "refresh_index": lambda: service.refresh(),
        "status": lambda: service.status(),
    }
    try:
        return run[name]()
    except Exception as e:  # the session goes on after a failure
        return {"state": "error", "reason": str(e).splitlines()[0] if str(e) else type(e).__name__, "answer": rendered("error")}


def result(service: Service, method: str, params: dict) -> dict:
    if method == "initialize":
        return {
            "protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "fathomline", "version": "1"},
            "instructions": "where_next names files to open next for a task; in any state but ok search as usual.",
        }
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": TOOLS}
    if method == "tools/call":
        out = called(service, params.get("name"), params.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(out, ensure_ascii=False)}], "isError": out.get("state") == "error"}
    raise Refused(NO_METHOD, f"no method {method}")


def answered(service: Service, line: str) -> dict | None:
    """The answer to a message; None to a notification."""
    refusal = lambda code, message, of=None: {"jsonrpc": "2.0", "id": of, "error": {"code": code, "message": message}}
    try:
        message = json.loads(line)
    except ValueError:
        return refusal(NOT_JSON, "not JSON")
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return refusal(BAD_REQUEST, "not a request")
    if "id" not in message:
        return None
    params = message.get("params") or {}
    if not isinstance(params, dict):
        return refusal(BAD_PARAMS, "params must be an object", message["id"])
    try:
        return {"jsonrpc": "2.0", "id": message["id"], "result": result(service, message["method"], params)}
    except Refused as r:
        return refusal(r.code, r.message, message["id"])


def serve(service: Service, lines: Iterable[str], out: TextIO) -> None:
    """Answers until the lines end."""
    for line in lines:
        if line.strip() and (answer := answered(service, line)) is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()
