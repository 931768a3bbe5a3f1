"""Read-only compound files (versions 3 and 4), as Outlook messages use them."""

from __future__ import annotations

import struct

from docloom.functions import raw

END = 0xFFFFFFFA  # sector numbers from here on aren't sectors


class Node:
    """A storage: its streams and storages by name."""

    def __init__(self) -> None:
        self.items: dict[str, bytes | Node] = {}

    def stream(self, name: str) -> bytes | None:
        found = self.items.get(name.lower())
        return found if isinstance(found, bytes) else None

    def storage(self, name: str) -> Node | None:
        found = self.items.get(name.lower())
        return found if isinstance(found, Node) else None

    def storages(self, prefix: str) -> list[Node]:
        return [v for k, v in sorted(self.items.items()) if k.startswith(prefix.lower()) and isinstance(v, Node)]

    def text(self, tag: int) -> str:
        """A text property, Unicode or 8-bit; empty if it isn't there."""
        if (wide := self.stream(f"__substg1.0_{tag:04X}001F")) is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        narrow = self.stream(f"__substg1.0_{tag:04X}001E")
        return "" if narrow is None else raw.decode(narrow).rstrip("\0")


class Compound:
    def __init__(self, data: bytes):
        if not data.startswith(raw.OLE) or len(data) < 512:
            raise ValueError("not a compound file")
        version, shift, small = struct.unpack("<HxxHH", data[26:34])
        self.data, self.size, self.small = data, 1 << shift, 1 << small
        if version not in (3, 4) or shift not in (9, 12):
            raise ValueError("compound file version")
        directory, cutoff, first_small, _, first_more, _ = struct.unpack("<IxxxxIIIII", data[48:76])
        self.cutoff = cutoff
        blocks = list(struct.unpack("<109I", data[76:512]))
        seen: set[int] = set()
        while first_more < END and first_more not in seen:
            seen.add(first_more)
            more = self._numbers(self._sector(first_more))
            blocks += more[:-1]
            first_more = more[-1]
        self.fat = [n for b in blocks if b < END for n in self._numbers(self._sector(b))]
        entries = self._chain(directory)
        self.small_fat = self._numbers(self._chain(first_small)) if first_small < END else []
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise ValueError("compound file directory")
        start, size = struct.unpack("<IQ", self.entries[0][116:128])
        self.inner = self._chain(start)[:size] if start < END else b""
        self.root = self._storage(0, {0})

    @staticmethod
    def _numbers(block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) & ~3]))

    def _sector(self, n: int) -> bytes:
        block = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not block:
            raise ValueError("compound file sector")
        return block

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END:
            if n in seen or n >= len(self.fat):
                raise ValueError("compound file chain")
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _stream(self, entry: bytes) -> bytes:
        n, size = struct.unpack("<IQ", entry[116:128])
        size &= 0xFFFFFFFF if self.size == 512 else ~0
        if size >= self.cutoff:
            return self._chain(n)[:size]
        out, seen = [], set()
        while n < END and size:
            if n in seen or n >= len(self.small_fat):
                raise ValueError("compound file chain")
            seen.add(n)
            out.append(self.inner[n * self.small : (n + 1) * self.small])
            n = self.small_fat[n]
        return b"".join(out)[:size]

    def _storage(self, i: int, seen: set[int]) -> Node:
        node, open_ = Node(), [struct.unpack("<I", self.entries[i][76:80])[0]]
        while open_:
            k = open_.pop()
            if k >= min(END, len(self.entries)) or k in seen:
                continue
            seen.add(k)
            entry = self.entries[k]
            length, kind = struct.unpack("<HB", entry[64:67])
            name = entry[: max(length - 2, 0)].decode("utf-16-le", "replace").lower()
            open_ += struct.unpack("<II", entry[68:76])
            if kind == 1:
                node.items[name] = self._storage(k, seen)
            elif kind == 2:
                node.items[name] = self._stream(entry)
        return node
