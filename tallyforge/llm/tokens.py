"""Byte-level BPE ids by the tokenizers library, with a cache of whole units.

A byte-level tokenizer splits text before it merges, and always splits between a visible character
and a single space or line break that a visible character follows. Units between such places
therefore encode alike wherever they stand, and most units of a corpus repeat. A batch of texts is
split and its distinct units are found by Arrow; only units not seen before go through the tokenizer.
Texts with any other white space go through the tokenizer as they are. Long texts are first cut where
the splitting starts anew in any case (see ``_CUT``), so memory does not grow with the length of a text.
Tokenizer files of another kind encode every text whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space (in any reading of \\s) other than single inner spaces and line breaks; RE2 syntax.
_ODD = (
    r"[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    r"|  |\n\n| \n|\n |\A[ \n]|[ \n]\z"
)
#: Places where the splitting into words starts anew whatever stands before: white space after a visible character,
#: a digit after a Latin letter, a letter or digit after a stop. None lies inside the special token.
_CUT = re.compile(r"(?<=[!-~\w])(?=[ \t\n\x0b\x0c\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[.,;:!?])(?=[A-Za-z0-9])")
#: Characters from which on a text is cut, and after which a part ends at the next such place.
PART_CHARS = 1 << 17
#: Bytes of units and their ids kept by a worker: beyond half of it the older half goes, but for units seen again meanwhile.
CACHE_BYTES = 160 << 20
#: Bytes that a unit takes in the cache beside four a letter (a string, a bytes object, an entry of the table).
_UNIT_BYTES = 180
#: Bytes of text whose units are looked up together, and units whose ids are gathered together.
SLICE_BYTES, GATHER = 8 << 20, 1 << 19


def parts_of(text: str, chars: int = PART_CHARS) -> list[str]:
    """The text in parts of about ``chars`` characters that encode one by one as in the whole."""
    out, at = [], 0
    while len(text) - at > 2 * chars:
        cut = _CUT.search(text, at + chars)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]] if at else [text]


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 as itself, every other byte as the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else np.array(ids, "<u4").tobytes()


class Encoder:
    """Encodes texts into unsigned 32-bit ids."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec.get("pre_tokenizer") or {}
        self._tokenizer = Tokenizer.from_file(path)
        line = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._plain = len(line) != 1 or not (
            kind.get("type") == "ByteLevel"
            and kind.get("use_regex")
            and not kind.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec.get("post_processor")
        )
        self._line = line[0] if line else 0
        # A unit is a piece without its leading space, or with its leading line break.
        self._merge, self._stops = self._tokenizer.model.tokenize, {}
        self._seed = {"\n": np.array(line[:1], "<u4").tobytes()}
        self._new, self._old, self._held, self._half = dict(self._seed), {}, 0, cache_bytes // 2

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, u: str) -> bytes | None:
        """A unit of Latin letters and final stops: two pieces at most for the merges, no splitting needed."""
        core = u.rstrip(".,;:!?")
        letters, stops = core, u[len(core) :]
        first = core[:1] == "\n"
        if first:
            letters = core[1:]
        if len(stops) > 8 or not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0250"):
            return None
        code = (self._new.get(core) or self._old.get(core)) if stops else None
        if code is None:
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_VISIBLE)
            code = _packed([t.id for t in self._merge(shown if first else "\u0120" + shown)])
            code = self._seed["\n"] + code if first else code
        if not stops:
            return code
        if stops not in self._stops:
            self._stops[stops] = self._whole(stops).tobytes()
        return code + self._stops[stops]

    def _learn(self, units: list[str]) -> None:
        rest, new, merge = [], self._new, self._merge
        for u in units:
            if u.isalpha() and u.isascii():  # most units
                new[u] = _packed([t.id for t in merge("\u0120" + u)])
                continue
            code = self._word(u)
            if code is None:
                rest.append(u)
            else:
                new[u] = code
        for at in range(0, len(rest), 50):  # long texts cost the library more a unit
            self._learn_joined(rest[at : at + 50])

    def _learn_joined(self, units: list[str]) -> None:
        joined = "\n" + "\n".join(u[1:] if u[0] == "\n" else " " + u for u in units)
        ids = self._whole(joined)
        at = np.append(np.flatnonzero(ids == self._line), len(ids))
        if len(at) != len(units) + 1:
            for u in units:
                self._new[u] = self._whole(u if u[0] == "\n" else " " + u).tobytes()
            return
        raw, at = ids.tobytes(), (at * 4).tolist()
        for u, a, b in zip(units, at, at[1:], strict=False):
            self._new[u] = raw[a:b] if u[0] == "\n" else raw[a + 4 : b]

    def _codes(self, units: list[str]) -> list[bytes]:
        if self._held > self._half:
            self._old, self._new, self._held = self._new, dict(self._seed), 0
        new, old = self._new, self._old
        codes = list(map(new.get, units))
        fresh = [i for i, code in enumerate(codes) if code is None]
        names = [units[i] for i in fresh]
        unknown = []
        for u, code in zip(names, map(old.get, names), strict=True):
            if code is None:
                unknown.append(u)
            else:
                new[u] = code
        if unknown:
            self._learn(unknown)
        for i, u in zip(fresh, names, strict=True):
            codes[i] = new[u]
        self._held += _UNIT_BYTES * len(names) + 4 * sum(map(len, names))
        return codes

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts without odd white space."""
        pieces = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        offsets, units = np.asarray(pieces.offsets), pieces.flatten().dictionary_encode()
        del pieces
        which, codes = units.indices.to_numpy(), self._codes(units.dictionary.to_pylist())
        del units
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        pool, firsts = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes) - sizes
        del codes
        ends = np.cumsum(sizes[which])
        ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        for at in range(0, len(which), GATHER):
            part = which[at : at + GATHER]
            counts, stop = sizes[part], ends[at : at + GATHER]
            start = int(stop[0] - counts[0])
            places = np.repeat(firsts[part] - (stop - counts), counts)
            places += np.arange(start, start + len(places))
            np.take(pool, places, out=ids[start : start + len(places)])
        cuts = np.append(0, ends)[offsets].tolist()
        return [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; none is longer than two parts unless it has no place for a cut."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(texts[i].as_py())
        rest = np.flatnonzero(~odd)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy()[rest]) if len(rest) else np.empty(0, np.int64)
        at = 0
        while at < len(rest):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            for i, ids in zip(rest[at:upto].tolist(), self._slice(texts.take(pa.array(rest[at:upto]))), strict=True):
                out[i] = ids
            at = upto
        return out

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self._plain:
            return [self._whole(t) for t in texts.to_pylist()]
        long = pc.greater(pc.binary_length(texts), 2 * PART_CHARS).to_numpy(zero_copy_only=False)
        if not long.any():
            return self._some(texts)
        out: list = [None] * len(texts)
        rest = np.flatnonzero(~long)
        for i, ids in zip(rest.tolist(), self._some(texts.take(pa.array(rest))), strict=True):
            out[i] = ids
        for i in np.flatnonzero(long).tolist():
            parts, done = parts_of(texts[i].as_py()), []
            for at in range(0, len(parts), 16):
                done += self._some(pa.array(parts[at : at + 16], pa.string()))
            out[i] = np.concatenate(done)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
