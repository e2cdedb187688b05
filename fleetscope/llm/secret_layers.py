"""Secret patterns and the decoding worklist for one text."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import zstandard

# Kinds in the order in which spans with one start are listed. The first three are the base kinds.
KINDS = ["assign", "access", "hex", "private_key", "github", "slack", "google", "jwt"]
_RANK = {k: i for i, k in enumerate(KINDS)}

# The patterns of the base kinds, and well-known forms of credentials.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
OTHERS = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
    "github": re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
_MARKS = {"private_key": "-----BEGIN ", "github": "gh", "slack": "xox", "google": "AIza", "jwt": "eyJ"}

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 over several lines, the last of any length; margins may be quoted or indented.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>#*]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t>#*]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
_BREAK = re.compile(r"[^A-Za-z0-9+/_=-]+[#*>]*")
_SEPARATOR = re.compile(r"[/_+-]+")
# Printable runs of decoded bytes, of one byte a character and of two, in either order.
_RUN = re.compile(rb"(?:[\t\n\r\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}){8,}+")
_WIDE = {"utf-16-le": re.compile(rb"(?:[\t\n\r\x20-\x7E]\x00){8,}+"), "utf-16-be": re.compile(rb"(?:\x00[\t\n\r\x20-\x7E]){8,}+")}
_HEX_BYTES = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
# A token that could be encoded is at least so long; the shortest secret, in base64.
SHORTEST_TOKEN = 16
# Decompressed data is looked at in pieces of this size, which overlap, and which do not end inside an encoded token.
PIECE, OVERLAP = 1 << 20, 1 << 12
# An encoded token that reaches the end of a piece: base64 in one or more lines, hexadecimal or escapes, of one or two bytes a character.
_TOKEN = rb"(?:[A-Za-z0-9+/_=%\\&#;-]\x00?)"
_NEXT_LINE = rb"(?:[ \t]\x00?)*(?:\r\x00?)?\n\x00?(?:[ \t>#*]\x00?)*"
_LINES = rb"(?:" + _NEXT_LINE + _TOKEN + rb"{16,}+)*(?:" + _NEXT_LINE + _TOKEN + rb"{0,15})?"
_OPEN = re.compile(_TOKEN + rb"++" + _LINES)
_REST = re.compile(_TOKEN + rb"*+" + _LINES)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The base kinds: leftmost matches that do not overlap, the short ones left out."""
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    if _long_token(text, 32):
        for m in HEX.finditer(text):
            yield "hex", m.start(), m.end()


def _long_token(text: str, n: int) -> bool:
    return len(text) >= n and max(map(len, text.split()), default=0) >= n


def all_spans(text: str) -> Iterator[tuple[str, int, int]]:
    yield from base_spans(text)
    for kind, pattern in OTHERS.items():
        if _MARKS[kind] in text:
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


@dataclass
class Layer:
    """A decoded text. ``places`` has where each character begins and ends in the given text; None: all at ``whole``."""

    text: str
    whole: tuple[int, int]
    places: tuple[np.ndarray, np.ndarray] | None = None
    root: bool = False

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.root:
            return start, end
        if self.places is None:
            return self.whole
        return int(self.places[0][start]), int(self.places[1][end - 1])

    def slots(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each of these characters in the given text."""
        if self.root:
            return np.arange(start, end), np.arange(start + 1, end + 1)
        if self.places is None:
            return np.full(end - start, self.whole[0]), np.full(end - start, self.whole[1])
        return self.places[0][start:end], self.places[1][start:end]


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the text that hold a secret, plainly or under any nesting of encodings."""
    found = set(base_spans(text))
    # Depth first: of each level only the layer being read is held, what follows it is decoded when its turn comes.
    work, seen = [iter([Layer(text, (0, len(text)), root=True)])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        name = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if not layer.root else b""
        # The same layer in another place is a find of its own; the same in its own place is a cycle.
        if (name, layer.whole) in seen:
            continue
        seen.add((name, layer.whole))
        for kind, start, end in all_spans(layer.text):
            found.add((kind, *layer.outer(start, end)))
        work.append(unwrapped(layer))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers one decoding below: escapes of the whole layer, and each token that decodes."""
    text = layer.text
    if "%" in text and _URL.search(text):
        yield _replaced(layer, _URL, lambda m: unquote_to_bytes(m).decode("utf-8", "replace"))
    if ("\\" in text or "&#" in text) and _ESCAPE.search(text):
        yield _replaced(layer, _ESCAPE, _character)
    if _long_token(text, SHORTEST_TOKEN):
        for m in _BASE64.finditer(text):
            yield from _aligned(layer, m.start(), m[0])
        if "\n" in text:
            for m in _WRAPPED.finditer(text):
                if "\n" in m[0]:
                    yield from _aligned(layer, m.start(), m[0])
        if _long_token(text, 24):
            for m in _HEX_BYTES.finditer(text):
                yield from _opened(layer, m.start(), m.end(), binascii.unhexlify(m[0]))


def _character(escape: str) -> str:
    if escape[0] == "&":
        return html.unescape(escape)
    code = int(escape[2:], 16)
    return chr(code) if code < 0x110000 else escape


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer:
    """The layer with every match decoded; characters keep their places."""
    parts, places, at = [], [], 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        parts += [layer.text[at:m.start()], new]
        places.append(layer.slots(at, m.start()))
        places.append(tuple(np.full(len(new), x) for x in layer.outer(m.start(), m.end())))
        at = m.end()
    parts.append(layer.text[at:])
    places.append(layer.slots(at, len(layer.text)))
    return Layer("".join(parts), layer.whole, (np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])))


def _from_base64(token: str) -> bytes:
    token = token.rstrip("=").translate({0x2D: "+", 0x5F: "/"})
    try:
        return base64.b64decode(token[:len(token) - (len(token) % 4 == 1)] + "=" * (-len(token) % 4 if len(token) % 4 != 1 else 0))
    except binascii.Error:
        return b""


def _aligned(layer: Layer, start: int, token: str) -> Iterator[Layer]:
    """The layers of a base64 token read from each of four alignments, and from behind each separator in it.

    What begins behind a separator is at one of the four alignments of the whole, so plain text is found by
    those; compressed data are only known by their first bytes, which are looked for at every separator.
    """
    end = start + len(token)
    joined = _BREAK.sub("", token)
    for k in range(4):
        data = _from_base64(joined[k:])
        # Another alignment of data that is no text gives no long printable runs; compressed data begin a token.
        yield from _opened(layer, start, end, data)
    for m in _SEPARATOR.finditer(joined):
        for at in range(m.start() + 1, m.end() + 1):
            if at > 3 and any(_from_base64(joined[at:at + 12]).startswith(h) for h in _HEADS):
                yield from _opened(layer, start, end, _from_base64(joined[at:]))


def _opened(layer: Layer, start: int, end: int, data: bytes) -> Iterator[Layer]:
    """Layers of decoded bytes: the text in them, or in what they hold compressed."""
    whole = layer.outer(start, end)
    for piece in _decompressed(data):
        for text in _texts(piece):
            yield Layer(text, whole)


# First bytes of gzip, bzip2, xz, zstandard and the common zlib levels.
_HEADS = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")


def _opener(data: bytes):
    """A new decompressor for data that begin like its format."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _decompressed(data: bytes) -> Iterator[bytes]:
    """The data as they are, and what they hold compressed."""
    yield data
    if data[:4] == b"\x28\xb5\x2f\xfd":
        yield from _overlapping(_zstd(data))
    elif _opener(data) is not None:
        yield from _overlapping(_members(data))


def _members(data: bytes) -> Iterator[bytes]:
    """What all members of a stream give, one after the other; what follows the last is given as it is."""
    while (opener := _opener(data)) is not None:
        yield from _pieces(opener, data)
        if not opener.eof:
            return
        # Members may be padded with zeros.
        data = opener.unused_data.lstrip(b"\x00")
    if data:
        yield data


def _pieces(opener, data: bytes) -> Iterator[bytes]:
    """What a decompressor gives, piece by piece; broken data give what comes before the fault."""
    try:
        while True:
            piece = opener.decompress(data, PIECE)
            if piece:
                yield piece
            data = getattr(opener, "unconsumed_tail", b"")
            if opener.eof or not (piece or data):
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def _zstd(data: bytes) -> Iterator[bytes]:
    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            while piece := reader.read(PIECE):
                yield piece
    except zstandard.ZstdError:
        return


def _overlapping(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces with what went before them: 4 KiB, and all of a token that is still open, which is held until it ends.

    A piece equal to an earlier one, as in data that repeat themselves, is given once.
    """
    held, opened, seen = [], False, set()
    for piece in pieces:
        if opened and _REST.match(piece).end() == len(piece):
            held.append(piece)
            continue
        whole = b"".join([*held, piece])
        name = hashlib.blake2b(whole, digest_size=16).digest()
        if name not in seen:
            seen.add(name)
            yield whole
        start = _open_start(whole)
        opened = start < len(whole)
        held = [whole[max(0, start - OVERLAP):]]
    if opened and len(held) > 1:
        yield b"".join(held)


def _open_start(data: bytes) -> int:
    """Where the token that reaches the end of the data begins, or their end."""
    size = OVERLAP
    while True:
        last, tail = None, data[-size:]
        for last in _OPEN.finditer(tail):
            pass
        if last is None or last.end() < len(tail):
            return len(data)
        # A token that begins with the tail, or shortly after, may have begun before it.
        if last.start() > size // 2 or size >= len(data):
            return len(data) - len(tail) + last.start()
        size *= 8


def _texts(data: bytes) -> Iterator[str]:
    """The printable runs of the bytes, one a line, and those of two bytes a character."""
    runs = _RUN.findall(data)
    if runs:
        yield "\n".join(r.decode("utf-8", "replace") for r in runs)
    if b"\x00" in data:
        for name, pattern in _WIDE.items():
            wide = [r.decode(name) for r in pattern.findall(data)]
            if wide:
                yield "\n".join(wide)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
