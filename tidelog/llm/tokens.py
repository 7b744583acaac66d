"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

A text is cut only where the pre-tokenizers of these vocabularies always cut: at (or before) a blank or line end that
follows no blank, and before a comma or full stop that follows a Latin letter or a digit. So a text's ids are the
joined ids of its pieces. Arrow cuts a batch's texts and numbers its distinct pieces; only pieces that the cache lacks are
encoded by the library: plain Latin words in one call, by the same model without the steps that change nothing for them
(their ids are told apart by their widths or word ends), the others one by one. A text that may hold one of the
vocabulary's added tokens (the library looks for those before anything else) is encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; of a full cache, those go that the fewest batches had.
CACHE = 300_000
#: Rows of a batch; more of them share more pieces.
TOKEN_ROWS = 1024
#: Characters of texts whose pieces are numbered together.
AT_ONCE = 1 << 22
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = rf"^[ \n]?[{_LATIN}]+$"
#: A comma or full stop that isn't cut off: one that may be tied to the character before it (a blank too, if it has ids).
_TIED, _TIED_OR_BLANK = rf"[^0-9{_LATIN}\t\n\r ][.,]", rf"[^0-9{_LATIN}][.,]"
#: A blank or line end after a blank: such texts are not cut there.
_RUN = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]"


def _byte_letters(lower: bool) -> np.ndarray:
    """For each byte of a plain piece, the letter that byte-level vocabularies write, lower-cased if asked for.

    A plain piece's bytes beyond ASCII belong to Latin letters, whose small forms lie 0x20 above in the second byte. A
    byte 0 stands between pieces: a blank here.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = np.zeros(256, "<u2")
    letter[plain] = plain
    letter[rest] = 256 + np.arange(len(rest))
    if lower:
        letter[65:91] = letter[97:123]
        letter[0x80:0x9F] = letter[0xA0:0xBF]
    letter[0] = 32
    return letter


class Encoder:
    """ids() gives, for each text, the ids of the library's encode() as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.lib.model)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        with open(path) as f:
            spec = json.load(f)
        kind, vocab = json.dumps([spec["normalizer"], spec["pre_tokenizer"]]), spec["model"]["vocab"]
        self.size = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
        self.added = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self.words = spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in kind and r"[\\p{L}]+" in kind and '"ByteLevel"' in kind
        self.bytes = not spec["normalizer"] and '"use_regex": true' in kind and '"add_prefix_space": false' in kind
        self.marks = np.zeros(self.size, np.int64)  # whether an id ends a word, or its width in bytes
        for t, i in vocab.items():
            self.marks[i] = t.endswith("</w>") if self.words else len(t)
        self.letters = _byte_letters(self.words)
        self.known, self.sizes, self.flat, self.used = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _each(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids and all ids of pieces that are encoded one by one."""
        found = [e.ids for e in self.lib.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), "<u4")

    def _plain(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(pieces):
            return self._each(pieces)
        text = pc.binary_join(pa.scalar(pieces, pa.list_(pa.string())), "\0").as_py().encode().replace(b"\n", b"\n\0")
        text = self.letters[np.frombuffer(text, np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        grown = np.cumsum(self.marks[ids])
        want = np.arange(1, len(pieces) + 1) if self.words else np.cumsum(pc.binary_length(pieces).to_numpy())
        ends = np.searchsorted(grown, want) + 1
        if not len(grown) or grown[-1] != want[-1] or (grown[ends - 1] != want).any():
            return self._each(pieces)
        return np.diff(ends, prepend=0), ids

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The cache's numbers of distinct pieces; those that it lacks are encoded and added."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        if len(new):
            plain = pc.match_substring_regex(new, _PLAIN)
            parts = [new.filter(plain), new.filter(pc.invert(plain))]
            found = [self._plain(parts[0]), self._each(parts[1])]
            self.known = pa.concat_arrays([self.known, *parts])
            self.sizes = np.concatenate([self.sizes, *(f[0] for f in found)])
            self.flat = np.concatenate([self.flat, *(f[1] for f in found)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            at = pc.index_in(pieces, value_set=self.known)
        return at.to_numpy(zero_copy_only=False)

    def _prune(self) -> None:
        if len(self.known) > CACHE:
            least = 2
            while (self.used >= least).sum() > CACHE // 2:
                least += 1
            kept = self.used >= least
            self.flat = self.flat[np.repeat(kept, self.sizes)]
            self.known, self.sizes, self.used = self.known.filter(pa.array(kept)), self.sizes[kept], self.used[kept] // 2

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        tied = pc.match_substring_regex(texts, _TIED if self.words else _TIED_OR_BLANK)
        if self.words:  # blanks carry no ids
            apart = pc.replace_substring(pc.replace_substring(texts, ".", " ."), ",", " ,")
            return pc.ascii_split_whitespace(pc.if_else(tied, texts, apart))
        lines = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        apart = pc.replace_substring(pc.replace_substring(lines, ".", "\0."), ",", "\0,")
        whole = pc.or_(pc.match_substring_regex(texts, _RUN), pc.match_substring(texts, "\0"))
        lists = pc.split_pattern(pc.if_else(tied, lines, apart), "\0")
        if not pc.any(whole).as_py():
            return lists
        return pa.array([[t] if w else p for t, w, p in zip(texts.to_pylist(), whole.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))

    def _joined(self, texts: pa.Array) -> list[bytes]:
        lists = self._cut(texts)
        offsets = lists.offsets.to_numpy()
        numbered = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self._prune()
        own = self._numbers(numbered.dictionary)
        self.used[own] += 1
        codes = own[numbered.indices.to_numpy()]
        size = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat((np.cumsum(self.sizes) - self.sizes)[codes] - ends[:-1], size) + np.arange(ends[-1])
        out, at = self.flat[places].tobytes(), (4 * ends[offsets - offsets[0]]).tolist()
        return [out[b:e] for b, e in zip(at[:-1], at[1:], strict=True)]

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def ids(self, texts: pa.Array | list[str | None], at_once: int | None = None) -> list[bytes]:
        """A null text counts as empty. Fewer characters at once take less memory and some more time."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not (self.words or self.bytes):
            return self._whole(texts)
        if self.added and pc.any(marked := pc.match_substring_regex(texts, self.added, ignore_case=True)).as_py():
            out, whole = self.ids(pc.if_else(marked, "", texts), at_once), iter(self._whole(texts.filter(marked)))
            return [next(whole) if m else x for m, x in zip(marked.to_pylist(), out, strict=True)]
        out: list[bytes] = []
        grown = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // (at_once or AT_ONCE)
        edges = np.flatnonzero(np.append(True, grown[1:] != grown[:-1])).tolist() if len(texts) else []
        for b, e in zip(edges, [*edges[1:], len(texts)], strict=True):
            out += self._joined(texts.slice(b, e - b))
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    return Encoder(path)
