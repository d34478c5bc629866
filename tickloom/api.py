"""The query API over one or two event logs: meta, events, series, diff, determinism; as DataFrames or JSON over HTTP."""

from __future__ import annotations

import json
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.errors import ReplayError
from tickloom.operators import features, selection, summary


@dataclass(frozen=True)
class Query:
    """What a request selects; each part may be missing."""

    from_seq: int | None = None
    to_seq: int | None = None
    symbol: str | None = None
    limit: int | None = None

    @classmethod
    def parse(cls, text: str) -> Query:
        given = {k: v[-1] for k, v in parse_qs(text).items()}
        number = lambda k: int(given[k]) if k in given else None
        return cls(number("from_seq"), number("to_seq"), given.get("symbol"), number("limit"))


class Api:
    """Functions over a log; `other` is the log that diff compares it with."""

    def __init__(self, events: DataFrame, other: DataFrame | None = None):
        self.log, self.other = events, other
        if events.isEmpty():
            raise ReplayError("no events in the log")

    def _slice(self, q: Query, what: str, log: DataFrame | None = None) -> DataFrame:
        return selection.select_events(self.log if log is None else log, q.from_seq, q.to_seq, q.symbol, q.limit, selection.DEFAULT_LIMITS[what])

    def meta(self) -> DataFrame:
        return summary.meta(self.log)

    def events(self, q: Query = Query()) -> DataFrame:
        return self._slice(q, "events")

    def series(self, q: Query = Query()) -> DataFrame:
        """Features of the slice, which start cold at its first row."""
        return features.series(self._slice(q, "series")).orderBy("sequence")

    def diff(self, q: Query = Query()) -> DataFrame:
        """Positions of the slices, cut to the limit on both sides first; a log compared with itself if there is no other."""
        return summary.parser_diff(self._slice(q, "diff"), self._slice(q, "diff", self.log if self.other is None else self.other))

    def determinism(self, q: Query = Query()) -> DataFrame:
        return summary.determinism_report(self._slice(q, "diff"))

    def answer(self, path: str, query: str) -> str | None:
        """JSON of a request; None for an unknown path."""
        q, name = Query.parse(query), path.removeprefix("/api/")
        if name in ("events", "series"):
            rows = getattr(self, name)(q).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()
            return "[" + ",".join(r[0] for r in rows) + "]"
        if name == "meta":
            return json.dumps(self.meta().first().asDict())
        if name == "diff":
            return json.dumps({"determinism": self.determinism(q).first().asDict(), "parser": self.diff(q).first().asDict()})
        return None


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """An HTTP server of /api/meta, /api/events, /api/series and /api/diff; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            try:
                body, status = api.answer(url.path, url.query), 200
                if body is None:
                    body, status = json.dumps({"error": "not found"}), 404
            except ValueError as e:
                body, status = json.dumps({"error": str(e)}), 400
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
