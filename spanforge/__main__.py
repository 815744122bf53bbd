"""``python -m spanforge``: ingest, chunk, index, build, search, books, serve."""

from __future__ import annotations

import argparse
import json
import sys

from spanforge.api import DocumentStore
from spanforge.config import EngineConfig
from spanforge.server import serve
from spanforge.session import get_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--master", default="local[*]")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("ingest", "build"):
        verbs.add_parser(verb).add_argument("folder")
    for verb in ("chunk", "index", "books", "serve"):
        verbs.add_parser(verb)
    search = verbs.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=5)
    search.add_argument("--book")
    given = parser.parse_args(args)
    kb = DocumentStore(get_session(given.master), given.root, EngineConfig.from_env())
    if given.verb in ("ingest", "build"):
        for row in getattr(kb, given.verb)(given.folder).collect():
            print(f"failed: {row['slug']}: {row['error']}")
    elif given.verb == "search":
        print(json.dumps(kb.search(given.query, given.top_k, given.book), indent=2))
    elif given.verb == "books":
        print(json.dumps(kb.list_books(), indent=2))
    elif given.verb == "serve":
        serve(kb, sys.stdin, sys.stdout)
    else:
        getattr(kb, given.verb)()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
