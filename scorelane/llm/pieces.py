"""Cutting texts into the matches of a tokenizer's pattern, with a bounded memory of encoded parts.

In the patterns used here a match ends wherever a space that another character follows begins,
between a letter and a mark such as a full stop, and on both sides of a single line feed between
characters that aren't white space. Texts without runs of white space can thus be cut at these
places into parts, whose encodings follow one another as in the whole text; few parts hold more
than one match. Other texts, and those with a zero character, are cut by the pattern itself, whose
matches are parts as well. Arrow cuts and numbers the parts of a batch, so that Python sees each
distinct part of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Neighbouring white space (a superset of what any pattern calls so), a space at the end, or a zero.
RUN = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}| \z|\x{00}"
#: A Latin letter before a mark that isn't a letter, a number or white space in any pattern.
MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?])"
#: Bytes of encoded parts that a worker remembers in each of two memories, and what an entry takes besides its letters and ids.
REMEMBERED, ENTRY = 40 << 20, 220


class Pieces:
    """encode(matches) gives an encoding each (bytes); join puts encodings of neighbours together.

    Parts are remembered in two memories: a full one becomes the older one, and parts found there
    move to the new one, so that frequent parts stay and rare ones go.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], join: Callable[[list[bytes]], bytes]):
        self.findall, self.encode, self.join = regex.compile(pattern).findall, encode, join
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, found: dict[str, bytes]) -> None:
        more = sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        if self.held + more > REMEMBERED:
            self.older, self.parts, self.held = self.parts, {}, 0
        if more <= REMEMBERED:
            self.parts.update(found)
            self.held += more

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Encodings of distinct parts, remembered ones looked up; a match is a part of its own."""
        known, older = self.parts, self.older
        found = [known.get(p) for p in parts]
        missing = [p for p, e in zip(parts, found, strict=True) if e is None]
        got = {p: older[p] for p in missing if p in older} if older else {}
        new = [p for p in missing if p not in got] if got else missing
        cut = list(map(self.findall, new))
        single = [p for p, c in zip(new, cut, strict=True) if len(c) == 1]
        longer = [(p, c) for p, c in zip(new, cut, strict=True) if len(c) != 1]
        got.update(zip(single, self.encode(single), strict=True))
        matches = {m for _, c in longer for m in c if m not in got}
        old = {m: known.get(m, older.get(m)) for m in matches if m in known or m in older}
        unknown = [m for m in matches if m not in old]
        fresh = dict(zip(unknown, self.encode(unknown), strict=True))
        every = got | old | fresh
        for p, c in longer:
            got[p] = self.join([every[m] for m in c])
        self._keep(got | fresh)
        return [got[p] if e is None else e for p, e in zip(parts, found, strict=True)]

    def encoded(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Encodings of the distinct parts, the number of each part, and where the texts end in these.

        Null texts count as empty; empty parts are left out.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, RUN)
        marked = pc.replace_substring_regex(pc.if_else(odd, "", texts), MARK, "\\1\0\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n\0"), " ", "\0 ")
        lists = pc.split_pattern(marked, "\0")
        if pc.any(odd).as_py():
            cut = [self.findall(t) for t in texts.filter(odd).to_pylist()]
            lists = _replaced(lists, odd, cut)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        numbered = flat.dictionary_encode()
        codes = numbered.indices.to_numpy().astype(np.int64)
        parts = numbered.dictionary.to_pylist()
        full = np.array([bool(p) for p in parts], bool)[codes] if parts else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(full)])[offsets[1:] - offsets[0]]
        return self._parts(parts), codes[full], ends


def _replaced(lists: pa.Array, odd: pa.Array, cut: list[list[str]]) -> pa.Array:
    """The lists with those marked ``odd`` exchanged, in order, for the ones in ``cut``."""
    both = pa.concat_arrays([lists, pa.array(cut, lists.type)])
    marks = odd.to_numpy(zero_copy_only=False)
    return both.take(pa.array(np.where(marks, len(lists) + np.cumsum(marks) - 1, np.arange(len(lists)))))


def gather(sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions, in the concatenated encodings of the distinct parts, of all tokens in order."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    return np.arange(n.sum()) + np.repeat(starts[codes] - (np.cumsum(n) - n), n)
