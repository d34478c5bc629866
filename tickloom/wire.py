"""Events on the wire: a JSON object a line, with the fields of the event's kind alone; and replays of a log over HTTP.

GET /replay streams a log's events as they fall due, in chunks of one line. from, to, speed, max_speed and step override the server's
settings for one request; 0 keeps a setting and flags add up. Each request has a replay of its own, and a client that reads slowly holds
back its own alone, as the socket blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlparse
from urllib.request import urlopen

from pyspark.sql import DataFrame

from tickloom.errors import EngineError, IngestError
from tickloom.schema import BOOK_FIELDS, COLUMNS, KEYS, QUOTE, TRADE, TRADE_FIELDS
from tickloom.streaming.replay import ReplayConfig, paced, parse_speed

FIELDS = {TRADE: TRADE_FIELDS, QUOTE: BOOK_FIELDS}


def to_wire(event: dict) -> bytes:
    """A line of JSON."""
    return json.dumps({c: event[c] for c in (*KEYS, *FIELDS[event["kind"]])}, ensure_ascii=False).encode() + b"\n"


def from_wire(line: bytes) -> dict:
    """The event of a line, all columns; an event without a payload, or with fields that do not fit its kind, is an error."""
    try:
        found = json.loads(line)
        wanted = (*KEYS, *FIELDS[found["kind"]])
    except (ValueError, TypeError, KeyError) as e:
        raise IngestError(f"no event: {line[:80]!r}") from e
    if set(found) != set(wanted) or any(isinstance(found[c], str) != (c in ("venue", "symbol", "kind")) or isinstance(found[c], (bool, float)) or found[c] is None for c in wanted):
        raise IngestError(f"no event: {line[:80]!r}")
    return {c: found.get(c) for c in COLUMNS}


def overrides(query: str) -> dict:
    """Keyword arguments of ReplayConfig.merged(), from a request."""
    given = {k: v[-1] for k, v in parse_qs(query).items()}
    flag = lambda name: given.get(name, "").lower() in ("1", "true")
    speed = given.get("speed", "0")
    return {"from_ns": int(given.get("from", 0)), "to_ns": int(given.get("to", 0)), "speed": 0.0 if speed in ("0", "") else parse_speed(speed), "max_speed": flag("max_speed"), "step_mode": flag("step")}


def serve_replay(events: DataFrame, config: ReplayConfig, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of /replay; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:
            url = urlparse(self.path)
            try:
                if url.path != "/replay":
                    raise FileNotFoundError
                asked = config.merged(**overrides(url.query))
            except FileNotFoundError:
                return self.send_error(404)
            except (ValueError, EngineError) as e:
                return self.send_error(400, str(e))
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            try:
                for row in paced(events, asked):
                    line = to_wire(row.asDict())
                    self.wfile.write(b"%x\r\n%s\r\n" % (len(line), line))
                self.wfile.write(b"0\r\n\r\n")
            except (BrokenPipeError, ConnectionResetError):  # the client has left
                self.close_connection = True

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def subscribe(address: str, **asked: object) -> Iterator[dict]:
    """Events of a server at host:port; `from_`, to, speed, max_speed and step ask for overrides."""
    query = urlencode({k.rstrip("_"): str(v) for k, v in asked.items() if v is not None})
    with urlopen(f"http://{address}/replay?{query}") as stream:
        for line in stream:
            yield from_wire(line)
