"""Where the public vocabulary files are; the path is always a parameter."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa


def vocabulary_bytes(path: str) -> bytes:
    """The file's bytes, read once on the driver; tasks get them with their function."""
    with open(path, "rb") as f:
        return f.read()


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


#: No piece of a SentencePiece model that splits by white space has a space after another character,
#: so a text falls into these units, which are encoded one by one.
UNIT = re.compile(rb" *[^ ]+| +")
#: Bytes of a generation; an entry costs ENTRY besides its unit and ids.
GENERATION, ENTRY, _CACHED_LENGTH, _AT_ONCE = 48 << 20, 180, 64, 1_000_000
HOT = 8_000


class Remembered:
    """unit -> ids as bytes. Two generations of so many bytes are remembered: when the younger is full it
    becomes the older, so frequent units stay and memory is bounded. `encode` takes a list of new units."""

    def __init__(self, encode, generation: int = GENERATION):
        self.encode, self.generation, self.young, self.old, self.size = encode, generation, {}, {}, 0
        #: The commonest units again, in a dict small enough for a processor's cache.
        self.hot: dict[bytes, bytes] = {}
        self._chunks = 0

    def _learn(self, units) -> dict[bytes, bytes]:
        """Ids of units that the younger generation lacks."""
        found = {u: self.old[u] for u in units if u in self.old}
        new = [u for u in units if u not in found]
        found.update(zip(new, self.encode(new), strict=True))
        held = {u: v for u, v in found.items() if len(u) <= _CACHED_LENGTH}
        size = sum(map(len, held)) + sum(map(len, held.values())) + ENTRY * len(held)
        if self.size + size > self.generation:
            self.old, self.young, self.size = self.young, {}, 0
        self.young.update(held)
        self.size += size
        return found

    def each(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        known = list(map(self.young.get, units))
        if new := [u for u, x in zip(units, known, strict=True) if x is None]:
            found = self._learn(new)
            known = [found[u] if x is None else x for u, x in zip(units, known, strict=True)]
        return known

    def many(self, texts: list[bytes], split) -> list[bytes]:
        """The ids of each text; `split` makes a text's units. Some texts at a time are held as units."""
        out, flat, ends, size = [], [], [0], 0
        for k, text in enumerate(texts, 1):
            flat += split(text)
            ends.append(len(flat))
            size += len(text)
            if size >= _AT_ONCE or k == len(texts):
                ids = list(map(self.hot.get, flat))
                gaps = [i for i, x in enumerate(ids) if x is None]
                rest = [flat[i] for i in gaps]
                known = list(map(self.young.get, rest))
                new = {u for u, x in zip(rest, known, strict=True) if x is None}
                found = self._learn(new) if new else {}
                for i, u, x in zip(gaps, rest, known, strict=True):
                    ids[i] = found[u] if x is None else x
                if self._chunks % 64 == 0:
                    seen = dict(zip(flat, ids, strict=True))
                    self.hot = {u: seen[u] for u, _ in Counter(flat).most_common(HOT)}
                self._chunks += 1
                out += [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                flat, ends, size = [], [0], 0
        return out


def plain_units(text: bytes) -> list[bytes]:
    """The units of a normalised text."""
    return UNIT.findall(text)


_STOPS = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \n]|\Z)")
_FINE = re.compile(rb" *[^ \n\xff]+|\n| +")


def fine_units(text: bytes) -> list[bytes]:
    """Units with line feeds, and a stop or comma at the end of a word, on their own. 0xff is in no text."""
    return _FINE.findall(_STOPS.sub(b"\xff\\1", text))


def lower_words(text: bytes) -> list[bytes]:
    """Words for a vocabulary that lower-cases and splits letters from stops: in lower case, a final stop
    or comma on its own. A text that may name a special token is only split."""
    return text.split() if b"<|" in text else _STOPS.sub(rb" \1", text.lower()).split()


_SHARED: dict[tuple, object] = {}


def shared(key: tuple, make):
    """The one object of a Python worker for this key, as an encoder: later tasks of the worker go on with
    it. Another key replaces it."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = make()
    return _SHARED[key]


def forget() -> None:
    """Frees what an encoding stage left in this Python worker; stages that follow one call it."""
    _SHARED.clear()
    pa.default_memory_pool().release_unused()
