"""A small client of the news protocol over TLS: group, overview, list, log-in, quit."""

from __future__ import annotations

import socket
import ssl
from collections.abc import Iterator

# The order of an overview line's fields where the server does not tell its own.
OVERVIEW = ["Subject", "From", "Date", "Message-ID", "References", "Bytes", "Lines"]


class ProtocolError(Exception):
    """An answer that is not the one asked for."""


class Client:
    """One connection; a context manager that says good-bye and closes it, whatever happened."""

    def __init__(self, host: str, port: int = 563, username: str | None = None, password: str | None = None, timeout: float = 60, tls: bool = True) -> None:
        raw = socket.create_connection((host, port), timeout)
        try:
            self.socket = ssl.create_default_context().wrap_socket(raw, server_hostname=host) if tls else raw
            self.file = self.socket.makefile("rb")
            self._answer("2")
            if username:
                if self.command(f"AUTHINFO USER {username}", "23").startswith("381"):
                    self.command(f"AUTHINFO PASS {password or ''}", "2")
        except BaseException:
            raw.close()
            raise

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        try:
            self.command("QUIT", "2")
        except (OSError, ProtocolError):
            pass
        self.file.close()
        self.socket.close()

    def _line(self) -> str:
        line = self.file.readline()
        if not line:
            raise ProtocolError("the connection ended")
        return line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")

    def _answer(self, good: str) -> str:
        line = self._line()
        if line[:1] not in good:
            raise ProtocolError(line)
        return line

    def command(self, text: str, good: str) -> str:
        if "\r" in text or "\n" in text:
            raise ValueError("a command is one line")
        self.socket.sendall(text.encode("utf-8", "surrogateescape") + b"\r\n")
        return self._answer(good)

    def _block(self) -> Iterator[str]:
        """The lines of a long answer; a leading point is doubled on the wire."""
        while (line := self._line()) != ".":
            yield line[1:] if line.startswith(".") else line

    def group(self, name: str) -> tuple[int, int, int]:
        """Count, first and last article number."""
        _, count, first, last, *_ = self.command(f"GROUP {name}", "2").split()
        return int(count), int(first), int(last)

    def _fields(self) -> list[str]:
        try:
            self.command("LIST OVERVIEW.FMT", "2")
        except ProtocolError:
            return OVERVIEW
        return [x[: -len(":full")] if x.lower().endswith(":full") else x.strip(":") for x in self._block()]

    def over(self, start: int, end: int) -> Iterator[tuple[int | None, dict[str, str]]]:
        """Number and record of every article from ``start`` to ``end``; a line without a number gives None."""
        names = self._fields()
        try:
            self.command(f"XOVER {start}-{end}", "2")
        except ProtocolError as e:
            if str(e).startswith(("420", "423")):  # no article there
                return
            raise
        for line in self._block():
            number, *values = line.split("\t")
            record = {}
            for k, value in enumerate(values):
                name = names[k] if k < len(names) else value.partition(":")[0]
                label = f"{name}:"
                record[name] = value[len(label) :].strip() if k >= len(OVERVIEW) and value.lower().startswith(label.lower()) else value
            yield (int(number) if number.isdigit() else None), record

    def groups(self) -> Iterator[tuple[str, int, int, str]]:
        """Name, first, last and flag of every group of the server."""
        self.command("LIST", "2")
        for line in self._block():
            name, last, first, flag = line.split()[:4]
            yield name, int(first), int(last), flag
