"""Tools of a document store over lines of JSON: a request {"id", "tool", "arguments"} a line, a reply {"id", "result" or "error"} a line."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable
from typing import TextIO

TOOLS = ("search", "search_book", "list_books", "get_chapter", "read_chunk", "grep_books")


def describe(store) -> list[dict]:
    """Name, purpose and parameters of every tool; those with a default are optional."""
    out = []
    for name in TOOLS:
        method = getattr(store, name)
        parameters = inspect.signature(method).parameters.values()
        out.append({"name": name, "description": inspect.getdoc(method) or "", "parameters": [p.name for p in parameters], "required": [p.name for p in parameters if p.default is p.empty]})
    return out


def reply(store, line: str) -> dict:
    """The reply to one request; whatever is wrong with it becomes an error, so that the server goes on."""
    number = None
    try:
        request = json.loads(line)
        number, tool = request.get("id"), request["tool"]
        if tool == "tools":
            return {"id": number, "result": describe(store)}
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool}")
        return {"id": number, "result": getattr(store, tool)(**request.get("arguments", {}))}
    except Exception as error:
        return {"id": number, "error": f"{type(error).__name__}: {error}"}


def serve(store, requests: Iterable[str], out: TextIO) -> None:
    """Answer requests until they end."""
    for line in requests:
        if line.strip():
            out.write(json.dumps(reply(store, line), default=str) + "\n")
            out.flush()
