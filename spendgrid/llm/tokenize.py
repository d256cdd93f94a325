"""Token ids of whole texts by a public tokenizer: each distinct chunk between spaces is encoded once for a worker."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_memory

#: Distinct chunks that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 900_000


class Encoder:
    """encode(column) gives (ids, tokens of each text), equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    keeps_space: the tokenizer joins a single space to the word after it (byte-level pre-tokenizers); else it
    drops white space. A text is cut before its spaces, which no pre-token straddles. With keeps_space that holds only
    where the character before the space is no white space: other texts are encoded whole."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pre, self.model, self.normal = self.whole.pre_tokenizer, self.whole.model, self.whole.normalizer
        # runs of Latin letters are one pre-token each; what the tokenizer makes of each letter is asked of it once
        self.latin = {ord(c): "".join(w for w, _ in self._pre(c)) for c in map(chr, [*range(65, 91), *range(97, 123), *range(128, 256)]) if c.isalpha()}
        self.plain = all(w == chr(c) for c, w in self.latin.items() if c < 128)  # ASCII letters stay as they are
        self.space = self._pre(" a")[0][0][: -len(self.latin[97])] if keeps_space else ""
        self._reset()

    def _reset(self) -> None:
        self.bare: dict[str, int] = {}  # chunk -> code: its ids are flat[ends[code]:ends[code + 1]]
        self.spaced: dict[str, int] = {}  # the same for a chunk with the space before it
        self.flat, self.ends = array("I"), array("q", [0])

    def _pre(self, chunk: str) -> list[tuple[str, tuple[int, int]]]:
        return self.pre.pre_tokenize_str(chunk if self.normal is None else self.normal.normalize_str(chunk))

    def _known(self, chunk: str, spaced: bool) -> array:
        code = (self.spaced if spaced else self.bare).get(chunk)
        if code is None:
            self._learn([chunk], spaced)
            code = len(self.ends) - 2
        return self.flat[self.ends[code] : self.ends[code + 1]]

    def _learn(self, chunks: list[str], spaced: bool) -> None:
        codes, prefix = (self.spaced, self.space) if spaced else (self.bare, "")
        tokenize, latin, plain, flat, ends = self.model.tokenize, self.latin, self.plain, self.flat, self.ends
        for chunk in chunks:
            if plain and chunk.isascii() and chunk.isalpha():
                ids = [t.id for t in tokenize(prefix + chunk)]
            elif chunk.isalpha() and max(chunk) < "\u0100":
                ids = [t.id for t in tokenize(prefix + chunk.translate(latin))]
            else:
                ids = self._composed(chunk, spaced)
            codes[chunk] = len(ends) - 1
            flat.extend(ids)
            ends.append(len(flat))

    def _composed(self, chunk: str, spaced: bool) -> list[int] | array:
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():  # a letter run and a mark are pre-tokens of their own
            return self._known(chunk[:-1], spaced) + self._known(chunk[-1], False)
        whole = " " + chunk if spaced and self.keeps_space else chunk
        if any(s in chunk for s in self.special):
            return self.whole.encode(whole, add_special_tokens=False).ids
        lines = chunk.split("\n")
        if len(lines) > 1 and not any(not x or x[-1].isspace() for x in lines):  # single line feeds are pre-tokens too, or dropped
            out = self._known(lines[0], spaced)[:]
            for line in lines[1:]:
                if self.keeps_space:
                    out += self._known("\n", False)
                out += self._known(line, False)
            return out
        return [t.id for word, _ in self._pre(whole) for t in self.model.tokenize(word)]

    def _codes(self, chunks: list[str], spaced: bool) -> list[int]:
        get = (self.spaced if spaced else self.bare).get
        out = list(map(get, chunks))
        if None in out:
            new = [i for i, k in enumerate(out) if k is None]
            self._learn([chunks[i] for i in new], spaced)
            for i in new:
                out[i] = get(chunks[i])
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends) > REMEMBERED:
            self._reset()
        if len(col) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if col.null_count:
            col = col.fill_null("")
        parts = pc.split_pattern(col, " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        off -= off[0]
        at, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = len(texts)
        first = np.zeros(len(at), bool)
        first[off[:-1]] = True
        odd = np.zeros(len(col), bool)
        codes = np.zeros(2 * n, np.int64)  # without and with the space before
        if self.keeps_space:
            # (an empty chunk or white space before a space: the cut there would not be safe)
            open_ended = pc.match_substring_regex(coded.dictionary, r"(^|[^!-~\x{a1}-\x{167f}\x{1681}-\x{1fff}])$").to_numpy(zero_copy_only=False)
            last = np.zeros(len(at), bool)
            last[off[1:] - 1] = True
            bad = open_ended[at] & ~last
            odd[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
            used = np.zeros(2 * n, bool)
            which = at + n * ~first
            used[which] = True
            for spaced, which_used in ((False, used[:n]), (True, used[n:])):
                k = np.flatnonzero(which_used)
                codes[k + n * spaced] = self._codes([texts[i] for i in k.tolist()], spaced)
        else:
            which = at
            codes[:n] = self._codes(texts, False)
        ends = np.frombuffer(self.ends, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        code = codes[which]
        begin, size = ends[code], ends[code + 1] - ends[code]
        if odd.any():
            size[np.repeat(odd, np.diff(off))] = 0
        done = np.cumsum(size)
        ids = flat[np.repeat(begin - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        per = np.add.reduceat(size, off[:-1])
        del ends, flat  # else the arrays could not grow
        if odd.any():
            pieces, p = [], np.r_[0, np.cumsum(per)]
            for i in range(len(col)):
                if odd[i]:
                    one = np.array(self.whole.encode(col[i].as_py(), add_special_tokens=False).ids, np.uint32)
                    pieces.append(one)
                    per[i] = len(one)
                else:
                    pieces.append(ids[p[i] : p[i + 1]])
            ids = np.concatenate(pieces)
        return ids, per


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One Encoder for each worker, tokenizer and rule; workers outlive tasks."""
    kept = worker_memory("encoders")
    if (path, keeps_space) not in kept:
        kept[path, keeps_space] = Encoder(path, keeps_space)
    return kept[path, keeps_space]


def with_end(ids: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with `end` after each text's, and the counts with it."""
    stop = np.cumsum(per)
    return np.insert(ids, stop, end).astype(np.uint32), per + 1


