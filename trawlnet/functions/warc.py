"""WARC records: the bytes of a record and back."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

VERSION = re.compile(r"WARC/[0-9.]+")
MAX_LINE = 10_000
CRLF = b"\r\n"


class FormatError(ValueError):
    """The bytes aren't a WARC record."""


@dataclass
class Record:
    headers: list[tuple[str, str]]
    content: bytes
    version: str = "WARC/1.0"

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def encode(self) -> bytes:
        headers = [(k, v) for k, v in self.headers if k.lower() != "content-length"] + [("Content-Length", str(len(self.content)))]
        head = [self.version, *(f"{k}: {v}" for k, v in headers)]
        return CRLF.join(x.encode() for x in head) + CRLF + CRLF + self.content + CRLF + CRLF


def _line(stream: BinaryIO, most: int) -> str | None:
    """A line without its end, or None at the end of the stream."""
    raw = stream.readline(most + 2)
    if not raw:
        return None
    if not raw.endswith(b"\n"):
        raise FormatError("a line is too long or cut off")
    return raw.rstrip(b"\r\n").decode("utf-8", "replace")


def headers(stream: BinaryIO, most: int = MAX_LINE) -> list[tuple[str, str]]:
    """Header lines up to an empty one; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    while (line := _line(stream, most)) is not None:
        if not line:
            return out
        if line[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise FormatError(f"no header: {line[:80]!r}")
        out.append((name.strip(), value.strip()))
    raise FormatError("the headers are cut off")


def read(stream: BinaryIO, most: int = MAX_LINE) -> Iterator[Record]:
    """Records of a stream, one after another, empty lines between them left out."""
    while (line := _line(stream, most)) is not None:
        if not line:
            continue
        if not VERSION.fullmatch(line):
            raise FormatError(f"no WARC version: {line[:80]!r}")
        found = headers(stream, most)
        length = next((v for k, v in found if k.lower() == "content-length"), None)
        if length is None or not length.isdigit():
            raise FormatError("no content length")
        content = stream.read(int(length))
        if len(content) < int(length):
            raise FormatError("the content is cut off")
        yield Record(found, content, line)


def opened(data: bytes) -> bytes:
    """Plain bytes of a record that may be compressed."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def http_parts(content: bytes, most: int = 8192) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status code, headers and body of a stored HTTP response."""
    import io

    stream = io.BytesIO(content)
    first = _line(stream, most) or ""
    if not (m := re.match(r"HTTP/[0-9.]+ (\d{3})", first)):
        raise FormatError(f"no HTTP status: {first[:80]!r}")
    found = headers(stream, most)
    return int(m[1]), found, stream.read()
