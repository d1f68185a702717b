"""Secrets in texts and in what texts hold in encoded form.

Each text is the first layer of a worklist. A layer is scanned, then unwrapped: percent escapes, Unicode
escapes, base64 runs and what they hold compressed become layers of their own, until nothing is left to
unwrap. Layers seen before at the same place are not taken again, so a layer that unwraps to itself ends.
Every byte of a layer knows which bytes of the text it came from; spans are mapped back with that.

The patterns hold ASCII only, so scanning works on UTF-8; offsets become code points at the end.
No pattern crosses a line, so escapes are unwrapped line by line.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import by_batch, texts

#: Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
#: Escapes and the characters that need none.
PERCENT_RUN = re.compile(rb"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/*!'()-])+")
UNICODE = re.compile(rb"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
#: Base64 at the beginning of a line, and least characters of a run over one or several lines.
LINE = re.compile(rb"[ \t]*([A-Za-z0-9+/_-]+)(={0,2})(\r?\n)?")
LEAST_CODE = 16
MAGIC = {b"\x1f\x8b": "gzip", b"\x78": "zlib", b"BZh": "bz2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
#: Expanded layers of more bytes are read in windows, each with the end of the one before; output of one step of a decompressor.
WINDOW = 4 << 20
OVERLAP = 1 << 16
PIECE = 1 << 20
#: Compressed layers within each other; what is deeper (archives that hold larger ones of themselves have no end) is counted as unread.
DEPTH = 100
CODE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Where something compressed may begin, also in percent escapes.
INNER = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd|(?<![A-Za-z0-9])x[\x01\x5e\x9c\xda]")
ZLIB_CODE = re.compile(rb"(?<=[/+_-])e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
INNER_PERCENT = re.compile(rb"(?i:%1f%8b%08|(?:%42|B)(?:%5a|Z)(?:%68|h)[1-9]|%fd(?:%37|7)(?:%7a|z)(?:%58|X)(?:%5a|Z)|(?:%28|\()%b5(?:%2f|/)%fd|(?<![a-z0-9])(?:%78|x)%(?:01|5e|9c|da))")

_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_CODE = bytes(104 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))
_RUN = re.compile(rb"h+")


def scan(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Base matches: leftmost, not overlapping within a kind, too short ones dropped."""
    lower, at = data.lower(), []
    for word in ASSIGN_WORDS:
        i = lower.find(word)
        while i >= 0:
            at.append(i)
            i = lower.find(word, i + 1)
    free = 0
    for i in sorted(at):
        if i >= free and (m := ASSIGN.match(data, i)):
            free = m.end()
            if len(m[2]) >= LEAST["assign"]:
                yield "assign", i, free
    for m in ACCESS.finditer(data):
        if m.end() - m.start() >= LEAST["access"]:
            yield "access", m.start(), m.end()
    for start, end in runs(data, _HEX, LEAST["hex"]):
        yield "hex", start, end


def runs(data: bytes, classes: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of one class of bytes, found without a step for each byte."""
    marked = data.translate(classes)
    i = marked.find(b"h" * least)
    while i >= 0:
        yield i, (end := _RUN.match(marked, i).end())
        i = marked.find(b"h" * least, end)


#: Where bytes of a layer stand in the text: the first and the end offset of what bytes ``a`` to ``b`` come from. Later bytes never
#: come from earlier places, so the ends of a span are those of its outer bytes. Numbers or arrays of them.
Place = Callable[[int, int], tuple[int, int]]
#: Places that go through so many others are written out.
STEPS = 50


def shifted(place: Place, by: int) -> Place:
    return lambda a, b: place(a + by, b + by)


def fixed(first: int, end: int) -> Place:
    return lambda a, b: (a * 0 + first, b * 0 + end)


def coded(place: Place, offset: int) -> Place:
    """Of base64 from its character ``offset``: a byte comes from the characters of its bits."""
    return lambda a, b: place(a * 8 // 6 + offset, (b * 8 - 1) // 6 + 1 + offset)


def joined(place: Place, pieces: list[tuple[int, int, int, bool]]) -> Place:
    """Of pieces one after another: their length, the bytes that they come from, and whether as a whole."""
    lengths, sources, stops, whole = map(np.array, zip(*pieces, strict=True))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def span(a, b):
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b - 1, "right") - 1
        first = np.where(whole[i], sources[i], sources[i] + a - starts[i])
        end = np.where(whole[j], stops[j], sources[j] + b - starts[j])
        return place(first, end)

    return span


@dataclass
class Layer:
    """Bytes, where they stand in the text, and the layers passed."""

    data: bytes
    place: Place
    via: str
    line: bool = False  # a whole line, of which the escaped runs are layers of their own
    marks: tuple[int, ...] = ()  # where zlib data may begin, known from the code
    steps: int = 0

    def span(self, start: int, stop: int) -> tuple[int, int]:
        first, end = self.place(start, stop)
        return int(first), int(end)

    def key(self) -> bytes:
        return blake2b(bytes([self.line]) + repr(self.span(0, len(self.data))).encode() + self.data, digest_size=16).digest()

    def part(self, start: int, stop: int) -> Layer:
        return Layer(self.data[start:stop], shifted(self.place, start), self.via, steps=self.steps + 1)

    def below(self, data: bytes, place: Place, via: str, marks: tuple[int, ...] = ()) -> Layer:
        steps = self.steps + 1
        if steps > STEPS:
            at = np.arange(len(data) + 1)
            first, end = place(at[:-1], at[1:])
            steps, place = 0, lambda a, b: (first[a], end[b - 1])
        return Layer(data, place, f"{self.via}>{via}", marks=marks, steps=steps)


@dataclass
class Found:
    spans: dict[tuple[int, int, int], str] = field(default_factory=dict)  # start, kind, end: the way to it
    unread: int = 0
    unread_at: list[tuple[int, int]] = field(default_factory=list)  # start and end of each layer not read to its end


def replaced(layer: Layer, pattern: re.Pattern, decoded, via: str) -> Layer | None:
    """The layer with each match replaced by what it stands for."""
    data, pieces, done = [], [], 0

    def kept(stop: int) -> None:
        if stop > done:
            data.append(layer.data[done:stop])
            pieces.append((stop - done, done, stop, False))

    for m in pattern.finditer(layer.data):
        if new := decoded(m[0]):
            kept(m.start())
            data.append(new)
            pieces.append((len(new), *m.span(), True))
            done = m.end()
    if not done:
        return None
    kept(len(layer.data))
    return layer.below(b"".join(data), joined(layer.place, pieces), via)


def from_percent(code: bytes) -> bytes:
    return bytes([int(code[1:], 16)])


def from_unicode(code: bytes) -> bytes:
    if code[:2] == b"\\x":
        points = chr(int(code[2:], 16))
    elif code[:3] == b"\\u{" or code[:2] == b"\\U":
        value = int(code.strip(b"\\uU{}"), 16)
        points = chr(value) if value < 0x110000 else ""
    else:
        points = bytes.fromhex(code.replace(b"\\u", b"").decode()).decode("utf-16-be", "surrogatepass")
    return points.encode("utf-8", "surrogatepass")


def from_base64(run: bytes) -> bytes | None:
    body = run.translate(None, b"\r\n=")
    if len(body) % 4 == 1:
        return None
    return base64.b64decode(body.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(body) % 4))


def compression(data: bytes) -> str | None:
    if data[1:4] == b"\x2a\x4d\x18" and data[0] >> 4 == 5:  # a frame of zstd to be skipped
        return "zstd"
    return next((name for magic, name in MAGIC.items() if data.startswith(magic)), None)


class Expander:
    """Expands what is fed to it, in pieces and in memory that does not grow: members one after another, and what follows as it is."""

    def __init__(self, how: str):
        self.start(how)
        self.members, self.plain, self.head = 0, False, b""
        self.done = self.failed = self.got = self.too_large = False

    def start(self, how: str) -> None:
        self.how, self.in_member = how, False
        if how == "zstd":
            self.engine = zstandard.ZstdDecompressor().decompressobj()
        else:
            self.engine = zlib.decompressobj(47) if how in ("gzip", "zlib") else bz2.BZ2Decompressor() if how == "bz2" else lzma.LZMADecompressor()

    def feed(self, data: bytes) -> Iterator[bytes]:
        i, n = 0, 256  # most of what only looks compressed fails at its beginning
        while i < len(data) and not self.done:
            yield from self._feed(bytes(data[i : i + n]))
            i, n = i + n, min(2 * n, OVERLAP)

    def _feed(self, data: bytes) -> Iterator[bytes]:
        if self.plain:
            yield data
            return
        if self.engine is None:
            yield from self.next_member(data)
            return
        more, given = bool(data), data
        while more:
            try:
                out, data, more = self.step(data)
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError) as error:
                if self.members and not self.in_member:  # what follows only looked like a member
                    self.plain = True
                    yield given
                    return
                self.done = self.failed = True
                self.too_large = "memory" in str(error)
                return
            if out:
                self.got = self.in_member = True
                yield out
            if self.engine.eof:
                self.engine, self.members = None, self.members + 1
                yield from self.next_member(data)
                return

    def next_member(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        """Begins the member that ``data`` holds; zeros between members are padding."""
        data = (self.head + data).lstrip(b"\0")
        self.head = b""
        if not data:
            return
        if len(data) < 6 and not last:
            self.head = data
            return
        if how := compression(data):
            self.start(how)
            yield from self._feed(data)
        else:
            self.plain = True
            yield data

    def step(self, data: bytes) -> tuple[bytes, bytes, bool]:
        """Some output, the input left, and whether there is more to do."""
        e = self.engine
        if self.how == "zstd":
            out = e.decompress(data[:256])  # a byte may stand for 32 KB
            rest = (e.unused_data if e.eof else b"") + data[256:]
            return out, rest, bool(rest)
        out = e.decompress(data, PIECE)
        if e.eof:
            return out, e.unused_data, bool(e.unused_data)
        if self.how in ("gzip", "zlib"):
            return out, e.unconsumed_tail, bool(e.unconsumed_tail) or len(out) == PIECE
        return out, b"", not e.needs_input

    def end(self) -> Iterator[bytes]:
        if self.engine is None and not self.plain and not self.done:
            yield from self.next_member(b"", last=True)


def unwrap(layer: Layer) -> Iterator[Layer | Code]:
    """The next layers below ``layer``, compressed ones still compressed."""
    data = layer.data
    for mark, pattern, decoded, via in ((b"%", PERCENT, from_percent, "url"), (b"\\", UNICODE, from_unicode, "unicode")):
        done = 0
        while (i := data.find(mark, done)) >= 0:
            if m := pattern.search(data, i):
                a = data.rfind(b"\n", 0, m.start()) + 1
                done = b if (b := data.find(b"\n", m.end())) >= 0 else len(data)
                if below := replaced(layer.part(a, done), pattern, decoded, via):
                    below.line = via == "url"
                    yield below
                    if via == "url":
                        for run in PERCENT_RUN.finditer(data, a, done):
                            if INNER_PERCENT.search(run[0]) and (below := replaced(layer.part(*run.span()), pattern, decoded, via)):
                                yield below
            else:
                break
    for start, stop in runs(data, _CODE, LEAST_CODE):
        yield from alignments(layer.part(start, stop))
    for lines in over_lines(data):
        place = joined(layer.place, [(b - a, a, b, False) for a, b in lines])
        yield from alignments(Layer(b"".join(data[a:b] for a, b in lines), place, layer.via, steps=layer.steps + 1))


def over_lines(data: bytes) -> Iterator[list[tuple[int, int]]]:
    """Base64 over several lines: what ends the first line, lines of one width, and what begins the last."""
    i = data.find(b"\n")
    while i >= 0:
        stop = i - (data[i - 1 : i] == b"\r")
        line = data[data.rfind(b"\n", 0, i) + 1 : stop]
        parts, at, width = [(stop - len(line) + len(line.rstrip(CODE)), stop)], i + 1, None
        while parts[0][0] < stop and (m := LINE.match(data, at)):
            n = m.end(1) - m.start(1)
            if width and n > width:
                break
            parts.append(m.span(1))
            if m[2] or not m[3] or width and n < width:
                break
            at, width = m.end(), n
        if len(parts) > 1 and sum(b - a for a, b in parts) >= LEAST_CODE:
            yield parts
        i = data.find(b"\n", max(i + 1, parts[-1][1] if len(parts) > 1 else 0))


@dataclass
class Code:
    """Base64 that is decoded from one of its first characters when its turn comes."""

    layer: Layer
    offset: int
    marks: tuple[int, ...]

    def decoded(self) -> Layer | None:
        body = self.layer.data[self.offset :]
        inner = from_base64(body[: len(body) - (len(body) % 4 == 1)])
        if inner and (self.marks or worth_reading(inner)):
            return self.layer.below(inner, coded(self.layer.place, self.offset), "base64", self.marks)
        return None


def alignments(code: Layer) -> Iterator[Code]:
    """What ``code`` stands for from each of its first four characters, as what is glued before it is of any length.

    Marks too short to be looked for within other bytes are looked for in the code; what begins there is the end of one of the four.
    """
    marks = [[], [], [], []]
    for m in ZLIB_CODE.finditer(code.data, 1, len(code.data) - LEAST_CODE + 3):
        marks[m.start() % 4].append(m.start() // 4 * 3)
    for offset in range(4):
        yield Code(code, offset, tuple(marks[offset]))


def worth_reading(data: bytes) -> bool:
    """Whether bytes, most of which may be noise of another alignment, hold secrets or further layers."""
    return bool(compression(data) or INNER.search(data) or PERCENT.search(data) or UNICODE.search(data) or next(runs(data, _CODE, LEAST_CODE), None) or next(scan(data), None) or next(over_lines(data), None))


class Search:
    """Scans layers and all below them. ``left``: bytes that compressed layers may still grow to, without a bound if None."""

    def __init__(self, found: Found, left: int | None):
        self.found, self.left = found, left

    def run(self, todo: list[Layer | Code]) -> None:
        seen = set()
        while todo:
            layer = todo.pop()
            if isinstance(layer, Code) and (layer := layer.decoded()) is None:
                continue
            if not layer.data or (key := layer.key()) in seen:
                continue
            seen.add(key)
            if how := compression(layer.data):
                below = self.expand(layer, how)
                if below is not None:
                    todo += below
                    continue
            todo += self.inside(layer)
            for kind, start, end in scan(layer.data):
                first, last = layer.span(start, end)
                span = first, KINDS.index(kind), last
                self.found.spans.setdefault(span, layer.via[1:])
            todo += unwrap(layer)

    def inside(self, layer: Layer) -> list[Layer]:
        """What compressed data after the beginning of ``layer`` holds; data that goes on to its end is taken once."""
        if layer.line:
            return []
        todo, rest = [], memoryview(layer.data)

        def found(start: int, how: str) -> Expander | None:
            below = Expanding(self, layer, how, start)
            below.feed(rest[start:])
            left = below.close()
            if below.expander.got or below.unread:
                todo.extend(left)
                return below.expander
            return None

        for start in layer.marks:
            found(start, "zlib")
        for m in INNER.finditer(layer.data, 1):
            if (expander := found(m.start(), compression(m[0]))) and not expander.failed:
                break
        return todo

    def expand(self, layer: Layer, how: str) -> list[Layer] | None:
        """What the compressed ``layer`` holds, but for its windows that are read already; None if it is not of that kind."""
        below = Expanding(self, layer, how)
        below.feed(layer.data)
        rest = below.close()
        return rest if below.expander.got or below.unread else None


class Expanding:
    """Expands what is fed to it and searches that: windows as soon as they are full, what is left when it is closed.

    All of it stands at the place of ``layer``. Compressed data that goes on beyond a window is handed on as it comes.
    """

    def __init__(self, search: Search, layer: Layer, how: str, start: int = 0):
        self.search, self.via, self.expander = search, f"{layer.via}>{how}", Expander(how)
        self.first, self.end = layer.span(start, max(start + 1, len(layer.data)))
        self.buffer, self.open, self.unread = bytearray(), [], False
        if sum(x in MAGIC.values() for x in self.via.split(">")) > DEPTH:
            self.leave()

    def leave(self) -> None:
        self.unread = self.expander.done = True
        self.search.found.unread += 1
        self.search.found.unread_at.append((self.first, self.end))

    def feed(self, data: bytes) -> None:
        if not self.unread:
            for piece in self.expander.feed(data):
                self.take(piece)
                if self.unread:
                    return
            if self.expander.too_large:
                self.leave()

    def take(self, piece: bytes) -> None:
        left = self.search.left
        if left is not None:
            self.search.left = max(0, left - len(piece))
            if len(piece) > left:
                piece = piece[:left]
                self.leave()
        done = 0
        while done < len(piece):
            part = piece[done : done + WINDOW - len(self.buffer)]
            done += len(part)
            self.buffer += part
            for tail in self.open:
                tail.feed(part)
            self.open = [x for x in self.open if not x.over()]
            if len(self.buffer) >= WINDOW:
                self.window()

    def layer(self) -> Layer:
        return Layer(bytes(self.buffer), fixed(self.first, self.end), self.via)

    def window(self) -> None:
        layer = self.layer()
        self.search.run([layer])
        self.open += [tail for tail in tails(self.search, layer) if not tail.over()]
        kept = layer.data[-OVERLAP:]
        # patterns allow any number of spaces in their middle
        spaces = len(layer.data[:-OVERLAP]) - len(layer.data[:-OVERLAP].rstrip(b" ")) if kept[:1] == b" " else 0
        if spaces:
            before = layer.data[: -OVERLAP - spaces][-OVERLAP:]
            kept = before + b" " + kept.lstrip(b" ")
        self.buffer = bytearray(kept)

    def close(self) -> list[Layer]:
        if not self.unread:
            for piece in self.expander.end():
                self.take(piece)
        for tail in self.open:
            tail.close()
        return [self.layer()] if self.buffer else []


class Tail:
    """Compressed data, plain or in a code, that goes on beyond a window."""

    def __init__(self, search: Search, layer: Layer, how: str, code: str, skip: int = 0):
        self.below = Expanding(search, Layer(b"", layer.place, f"{layer.via}{code and '>' + code}"), how)
        self.code, self.skip, self.rest, self.ended = code, skip, b"", False

    def feed(self, data: bytes) -> None:
        if self.ended:
            return
        if self.code == "base64":
            if m := re.search(rb"[^A-Za-z0-9+/_\r\n-]", data):
                data, self.ended = data[: m.start()], True
            body = self.rest + data.translate(None, b"\r\n")
            whole = len(body) - (len(body) % 4 if not self.ended else len(body) % 4 == 1)
            body, self.rest = body[:whole], body[whole:]
            data = from_base64(body) or b""
        elif self.code == "url":
            if (end := data.find(b"\n")) >= 0:
                data, self.ended = data[:end], True
            data = self.rest + data
            cut = at if not self.ended and (at := data.rfind(b"%", max(0, len(data) - 2))) >= 0 else len(data)
            data, self.rest = PERCENT.sub(lambda m: from_percent(m[0]), data[:cut]), data[cut:]
        data, self.skip = data[self.skip :], max(0, self.skip - len(data))
        self.below.feed(data)

    def over(self) -> bool:
        """Whether no more can come; what has come is searched then."""
        if not (self.ended or self.below.expander.done):
            return False
        self.close()
        return True

    def close(self) -> None:
        if not self.ended:
            self.ended = True
            if self.rest and self.code == "base64" and len(self.rest) > 1:
                self.below.feed(from_base64(self.rest) or b"")
        self.below.search.run(self.below.close())


def tails(search: Search, layer: Layer) -> Iterator[Tail]:
    """The compressed data that begins in a window, before what the next window repeats, each fed with the window's rest."""
    data, most = layer.data, len(layer.data) - OVERLAP

    def tail(start: int, how: str | None, code: str, skip: int = 0) -> Iterator[Tail]:
        if how and start < most:
            (new := Tail(search, layer, how, code, skip)).feed(data[start:])
            yield new

    for m in INNER.finditer(data, 0, most + 8):
        yield from tail(m.start(), compression(m[0]), "")
    line = data.rfind(b"\n") + 1
    if most - line > 0:
        for m in INNER_PERCENT.finditer(data, line, most + 24):
            yield from tail(m.start(), compression(PERCENT.sub(lambda x: from_percent(x[0]), m[0])), "url")
    run = len(data.rstrip(CODE + b"\r\n"))
    if run < most:
        kept = np.flatnonzero(~np.isin(np.frombuffer(data[run:], np.uint8), np.frombuffer(b"\r\n", np.uint8))) + run
        code = data[run:].translate(None, b"\r\n")
        for offset in range(4):
            inner = from_base64(code[offset : offset + (len(code) - offset) // 4 * 4]) or b""
            for m in INNER.finditer(inner):
                yield from tail(int(kept[offset + m.start() // 3 * 4]), compression(m[0]), "base64", m.start() % 3)


def secrets_of(data: bytes, max_expanded: int | None = None) -> Found:
    found = Found({(start, KINDS.index(kind), end): "" for kind, start, end in scan(data)})
    if not (b"%" in data or b"\\" in data or next(runs(data, _CODE, LEAST_CODE), None) or next(over_lines(data), None)):
        return found
    Search(found, max_expanded).run(list(unwrap(Layer(data, lambda a, b: (a, b), ""))))
    return found


def in_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if not spans or data.isascii():
        return spans
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    # an end inside a character cannot be: ends follow ASCII characters or whole escapes
    return [(int(points[a]), kind, int(points[b])) for a, kind, b in spans]


SECRETS = "array<struct<kind:string,start:bigint,end:bigint,via:string>>"


def find_secrets(docs: DataFrame, max_expanded: int | None = None) -> DataFrame:
    """``doc_id``, ``secrets`` (kind, start, end in code points, via: layers passed, empty for the text itself)
    by start, kind and end, and ``unread_layers`` (compressed layers not read to their end, as those beyond
    ``max_expanded`` bytes if that is given).

    Null and empty texts have none. Repeated rows stay repeated; other columns are not carried.
    """

    def run(doc_id, text):
        rows, unread = [], []
        for data in (x.encode() for x in text.to_pylist()):
            found = secrets_of(data, max_expanded)
            spans = sorted(found.spans)
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "via": found.spans[key]} for key, (a, k, b) in zip(spans, in_points(data, spans), strict=True)])
            unread.append(found.unread)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())])
        return doc_id, pa.array(rows, type=pa.list_(kind)), pa.array(unread, type=pa.int64())

    source = texts(docs)
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, secrets {SECRETS}, unread_layers long")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the spans of the text itself, and all spans as text."""
    base = F.filter("secrets", lambda s: s["via"] == "")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
        "unread_layers",
    )


def redact(docs: DataFrame, mark: str = "[secret]", max_expanded: int | None = None) -> DataFrame:
    """``docs`` with every secret, and the code of every layer not read to its end, replaced by ``mark``
    (overlapping ones by one) and ``n_chars`` counted anew.

    All columns are kept. Null texts stay null; texts without secrets stay as they are.
    """
    names = docs.columns
    text_at, counted_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def one(text: str | None) -> str | None:
        if not text:
            return text
        out, done, reach = [], 0, 0
        data = text.encode()
        found = secrets_of(data, max_expanded)
        for start, _, end in sorted([*found.spans, *((a, -1, b) for a, b in found.unread_at)]):
            if start >= reach:
                out += [data[done:start], mark.encode()]
            done = reach = max(reach, end)
        return b"".join([*out, data[done:]]).decode() if out else text

    def run(*columns):
        columns = list(columns)
        new = [one(x) for x in columns[text_at].to_pylist()]
        columns[text_at] = pa.array(new, type=pa.string())
        if counted_at is not None:
            columns[counted_at] = pa.array([n if x is None else len(x) for n, x in zip(columns[counted_at].to_pylist(), new, strict=True)], type=columns[counted_at].type)
        return columns

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
