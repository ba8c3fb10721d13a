"""A long-poll server as a streaming source.

The server is reached through a transport that is passed in: ``server()`` gives
address, key and position, ``check(server, key, ts)`` a reply with ``ts`` and
``updates`` or with ``failed``. The position is the stream's offset, so a query
that restarts goes on where it was.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Longest pause in seconds after network failures; pauses double from one second.
LONGEST_PAUSE = 30


class Transport(Protocol):
    def server(self) -> dict: ...

    def check(self, server: str, key: str, ts: str) -> dict: ...


class LongPoll:
    """The protocol: address, key and position, and what each failure renews."""

    def __init__(self, transport: Transport, ts: str | None = None, pause: Callable[[float], None] = time.sleep):
        self.transport, self.ts, self.pause = transport, ts, pause
        self.address = self.key = None
        self.backoff = 1

    def renew(self, keep: bool) -> None:
        """Address and key anew, and the position unless it is kept."""
        got = self.transport.server()
        self.address, self.key = got["server"], got["key"]
        if not keep or self.ts is None:
            self.ts = str(got["ts"])

    def _wait(self) -> None:
        self.pause(self.backoff)
        self.backoff = min(2 * self.backoff, LONGEST_PAUSE)

    def poll(self) -> list[dict]:
        """Updates of one check; none after a failure, which is mended for the next.

        Failure 1 brings a new position, 2 asks for a key, any other for both.
        Network errors are waited out; after other errors the server is asked again.
        """
        if self.address is None:
            self.renew(keep=self.ts is not None)
        try:
            reply = self.transport.check(self.address, self.key, self.ts)
        except (ConnectionError, TimeoutError):
            self._wait()
            return []
        except Exception:  # the transport may fail in any way
            self._wait()
            self.address = None
            return []
        self.backoff = 1
        failed = reply.get("failed")
        if failed is None:
            self.ts = str(reply.get("ts", self.ts))
            return list(reply.get("updates", []))
        if int(failed) == 1:
            self.ts = str(reply.get("ts", self.ts))
        else:
            self.renew(keep=int(failed) == 2)
        return []


def source(connect: Callable[[], Transport], name: str = "longpoll") -> type[DataSource]:
    """A data source for ``spark.dataSource.register``; its rows are (value string), one JSON object an update."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self):
            self.poll = LongPoll(connect())

        def initialOffset(self) -> dict:
            self.poll.renew(keep=False)
            return {"ts": self.poll.ts}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            self.poll.ts = start["ts"]
            rows = [(json.dumps(u, ensure_ascii=False),) for u in self.poll.poll()]
            return iter(rows), {"ts": self.poll.ts}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            """The same rows again, after a failure: the server is asked from the old position up to the new one."""
            again, rows = LongPoll(connect(), start["ts"], lambda _: None), []
            while again.ts != end["ts"]:
                before = again.ts
                rows += [(json.dumps(u, ensure_ascii=False),) for u in again.poll()]
                if again.ts == before:
                    break
            return iter(rows)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader()

    return Source
