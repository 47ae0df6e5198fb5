"""Token ids of whole texts with the tokenizers library, by way of a cache of pieces.

Both kinds of vocabulary used here split a text into words before they merge, and no merge crosses a space or a single
line break. So a text is cut before these, each distinct piece is encoded once a worker, in one call for all new pieces
of a batch, and a text's ids are the joined ids of its pieces. A comma or full stop after a letter is a word of its own,
so a piece is looked up without it. Where a cut would not be neutral (white space on both sides of it), the library gets
the whole text.

Pieces and their ids are Arrow arrays: a batch's pieces are numbered, looked up and put together by Arrow, and only those
that a worker has not seen become Python objects.
"""

from __future__ import annotations

import gc
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and their ids that a worker keeps, about; beyond that, what was met again stays. What one piece costs besides, and the longest kept.
CACHE, ENTRY, LONG = 16 << 20, 20, 64
#: Bytes of text to encode at once.
SLICE = 4_000_000
#: New pieces encoded as one text.
GROUP = 128
#: A comma or full stop that is a word of its own.
TAILED = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F][.,]$"
TEXT, IDS = pa.large_string(), pa.large_binary()


def vocabulary(name: str) -> str:
    """A file's place on this machine: a path as it is, or the name of a public vocabulary."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian arrays. Strings of special tokens in a text are ordinary text."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words, self.ids, self.met = pa.array([], TEXT), pa.array([], IDS), np.zeros(0, bool)
        self.tails = [pa.scalar(self.whole(x), IDS) for x in ("", ",", ".")]
        probe = self.tokenizer.encode("A é", add_special_tokens=False).tokens
        self.lower = probe[0].startswith("a")  # lower case, white space dropped
        ids = self.tokenizer.get_vocab()
        marked = lambda test: np.isin(np.arange(self.tokenizer.get_vocab_size()), [i for t, i in ids.items() if test(t)])
        if self.lower:
            self.separator, self.ends = marked(lambda t: t == "0</w>"), marked(lambda t: t.endswith("</w>"))
        else:
            self.begins, self.breaks = marked(lambda t: t.startswith("Ġ")), marked(lambda t: t == "Ċ")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """One array of ids a text; no text is null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        gc.disable()  # many short-lived objects, no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.lower:
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(TEXT))  # ascii_lower() spoils the slice of a large_string
        else:
            split = pc.split_pattern(pc.replace_substring(texts.cast(TEXT), "\n", " \n"), " ")
        numbered = split.flatten().dictionary_encode()
        code, pieces = numbered.indices.to_numpy(), numbered.dictionary
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        used, heads = np.ones(len(pieces), bool), []
        if not self.lower:
            # A text's first piece has no space before it: a piece of its own kind.
            first, later = bounds[:-1], np.ones(len(code), bool)
            later[first] = False
            used[:] = False
            used[code[later]] = True
            own, place = np.unique(code[first], return_inverse=True)
            heads = self._library(pieces.take(pa.array(own)).to_pylist())
            code = code.copy()
            code[first] = len(pieces) + place
        known, odd = self._lookup(pieces, used)
        found = pa.concat_arrays([known, pa.array(heads, IDS)]).take(pa.array(code))
        _, ends, raw = found.buffers()
        cuts = np.frombuffer(ends, np.int64)[found.offset :][bounds] // self.dtype.itemsize
        ids = np.frombuffer(raw, self.dtype, int(cuts[-1])) if raw and cuts[-1] else np.zeros(0, self.dtype)
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if odd.any():
            # A piece that starts with white space: its cut is not neutral.
            wrong = np.append(odd, np.zeros(len(heads), bool))[code]
            which = np.unique(np.searchsorted(bounds, np.flatnonzero(wrong), side="right") - 1).tolist()
            for i, whole in zip(which, self._library([texts[i].as_py() for i in which])):
                out[i] = np.frombuffer(whole, self.dtype)
        return out

    def _lookup(self, pieces: pa.Array, used: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """By piece: ids, and whether it is not to stand alone. What is not used gets none. New pieces are learned."""
        tailed = pc.match_substring_regex(pieces, TAILED)
        stems = pc.replace_with_mask(pieces, tailed, pc.binary_slice(pieces.filter(tailed).cast(IDS), 0, -1).cast(TEXT)).dictionary_encode()
        code, stems = stems.indices.to_numpy(), stems.dictionary
        at = pc.fill_null(pc.index_in(stems, value_set=self.words), -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] = True
        wanted = np.zeros(len(stems), bool)
        wanted[code[used]] = True
        missing = np.flatnonzero((at < 0) & wanted)
        new = stems.take(pa.array(missing))
        raw, alone = self._learn(new.to_pylist())
        raw = pa.array(raw, IDS)
        n = len(self.ids)
        at[at < 0] = n + len(raw)
        at[missing] = n + np.arange(len(raw))
        table = pa.concat_arrays([self.ids, raw, pa.array([b""], IDS)])
        tail = pc.if_else(tailed, pc.if_else(pc.ends_with(pieces, ","), self.tails[1], self.tails[2]), self.tails[0])
        found = pc.binary_join_element_wise(table.take(pa.array(at[code])), tail, pa.scalar(b"", IDS))
        odd = np.zeros(len(table), bool)
        odd[n : n + len(raw)] = ~alone
        self._keep(new, raw, alone & (pc.binary_length(new).to_numpy() <= LONG))
        return found, odd[at[code]]

    def _keep(self, words: pa.Array, ids: pa.Array, which: np.ndarray) -> None:
        which = pa.array(which)
        self.words, self.ids = pa.concat_arrays([self.words, words.filter(which)]), pa.concat_arrays([self.ids, ids.filter(which)])
        self.met = np.append(self.met, np.zeros(len(self.words) - len(self.met), bool))
        if self._size() > CACHE:
            met = pa.array(self.met)
            self.words, self.ids = self.words.filter(met), self.ids.filter(met)
            if self._size() > CACHE // 2:
                self.words, self.ids = self.words[:0], self.ids[:0]
            self.met = np.zeros(len(self.words), bool)

    def _size(self) -> int:
        return sum(pc.sum(pc.binary_length(x)).as_py() or 0 for x in (self.words, self.ids)) + ENTRY * len(self.words)

    def _library(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by itself."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of new pieces, and whether each may stand alone. They are encoded many to a text, and told apart in its ids."""
        if self.lower:
            plain = [w for w in new if w.isalpha()]
            other = [w for w in new if w and not w.isalpha()]
            between, apart = [w for w in other if "0" not in w], [w for w in other if "0" in w]
            got = dict(zip(plain, self._together(plain, " ", self.ends)))  # a word of letters has one last token
            got.update(zip(between, self._together(between, " 0 ", self.separator)))
            got.update(zip(apart, self._library(apart)))
            return [got.get(w, b"") for w in new], np.ones(len(new), bool)
        alone = [bool(w) and not (w[1:2] or " " if w[0] == "\n" else w[0]).isspace() for w in new]
        spaced = [w for w, a in zip(new, alone) if a and w[0] != "\n"]
        broken = [w for w, a in zip(new, alone) if a and w[0] == "\n"]
        got = dict(zip(spaced, self._together(spaced, " ", self.begins)))
        got.update(zip(broken, self._together([w[1:] for w in broken], "\n", self.breaks)))
        return [got.get(w, b"") for w in new], np.array(alone, bool)

    def _together(self, words: list[str], mark: str, edge: np.ndarray) -> list[bytes]:
        """Ids of the words, each with the mark before it (in lower case: without it). edge: by id, whether the token begins a word (in lower
        case: ends one, or stands between two)."""
        width, between, out = self.dtype.itemsize, mark != " ", []
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        for start in range(0, len(groups), 64):
            some = groups[start : start + 64]
            texts = [mark.join(g) + mark if self.lower else mark + mark.join(g) for g in some]
            for group, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                at = np.flatnonzero(edge[ids])
                if len(at) != len(group):
                    out += self._library([w if self.lower else mark + w for w in group])
                    continue
                if self.lower:
                    begins, ends = np.append(0, at[:-1] + 1), at + (0 if between else 1)
                else:
                    begins, ends = at, np.append(at[1:], len(ids))
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((begins * width).tolist(), (ends * width).tolist())]
        return out


@cache
def encoder(name: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(name)
