"""Byte-level BPE ids of whole texts, many chunks at a time.

The pre-tokeniser never joins a non-space with a following space, so a text may be cut before any space that a
non-space follows. Each distinct chunk is encoded once (by the library given) and kept in a bounded table; the
chunks of a batch of texts are found, looked up and put together again as NumPy vectors. Short chunks are keyed
by their bytes packed in an integer, longer ones by the bytes themselves, so there are no hash collisions.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np

from tailwise.llm.common import give_back, keep_tables

#: White space other than space and line feed; texts with any of it are cut by the general rule.
RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_RARE = RARE_SPACE[:8]
#: Bound of the tables of chunks: at half of it a new one starts, which takes over what is met again.
CHUNKS = 1_000_000
#: Bits of the number of rows of the tables that are asked first; a row holds the key last seen of those that fall on it.
ROW_BITS = 18
#: Bytes of text that are encoded together.
SLICE = 4_000_000
#: Kinds of bytes: ASCII letters 1, marks that start a new pre-token after one 2, space and line feed 3, others 0.
KINDS = bytes(1 if chr(b).isalpha() and b < 128 else 2 if b in b".,;:!?#$%&*|" else 3 if b in b" \n" else 0 for b in range(256))
#: Masks of the first 0 to 8 bytes of a number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BEFORE_WORD = re.compile(r" (?=\S)")


def plain(text: str) -> bool:
    """Whether the text may be cut before every space and line feed."""
    rare = ASCII_RARE if text.isascii() else RARE_SPACE
    return not ("  " in text or "\n\n" in text or " \n" in text or text.endswith(" ") or any(c in text for c in rare))


def units(text: str) -> list[str]:
    """The chunks of any text, by the general rule."""
    first, *rest = BEFORE_WORD.split(text)
    return [first, *(" " + r for r in rest)]


class BulkEncoder:
    """encode gives, for distinct strings, all ids in order and their number for each string. Texts that special
    matches may not be cut; whole gives their ids."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], chunks: int = CHUNKS, special: re.Pattern | None = None, whole: Callable[[str], list[int]] | None = None):
        self.encode, self.bound, self.special, self.whole = encode, chunks, special, whole
        self.short, self.long, self.n = {}, {}, 0
        self._age()

    def _age(self) -> None:
        """Begin a new table. The one before stays to look up what the new one lacks, the one before that goes."""
        aged = self.n > 0
        self.before = (self.short, self.long, self.pool, self.start, self.size) if aged else None
        self.short: dict[int, int] = {}
        self.long: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.recent = [np.zeros((1 << ROW_BITS, 2), np.int64), np.zeros((1 << ROW_BITS, 3), np.int64)]
        self.start, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        if aged:
            give_back()

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Places of new chunks with these ids."""
        first, more = self.n, len(sizes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while first + more > len(self.start):
            self.start, self.size = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[first : first + more] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + more] = sizes
        self.used += len(ids)
        self.n += more
        return range(first, self.n)

    def _places(self, keys: list, table: dict, text_of: Callable) -> np.ndarray:
        """Place of each of the distinct keys."""
        found = np.fromiter(map(table.get, keys, repeat(-1)), np.int64, len(keys))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [keys[k] for k in at.tolist()]
            if self.before:
                short, long, pool, start, size = self.before
                was = np.fromiter(map((short if table is self.short else long).get, new, repeat(-1)), np.int64, len(new))
                again = np.flatnonzero(was >= 0)
                n = size[was[again]]
                places = self._add(pool[np.repeat(start[was[again]] - np.cumsum(n) + n, n) + np.arange(n.sum())], n)
                table.update(zip([new[k] for k in again.tolist()], places, strict=True))
                found[at[again]] = places
                at = at[was < 0]
                new = [keys[k] for k in at.tolist()]
            if new:
                places = self._add(*self.encode([text_of(k) for k in new]))
                table.update(zip(new, places, strict=True))
                found[at] = places
        return found

    @staticmethod
    def _seen(recent: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of keys of one or two numbers (not 0) as the rows of recent know them, which of the keys are not there,
        and their rows."""
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[1:]:
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ k) * np.uint64(0xD6E8FEB86659FD93)
        row = (mixed >> np.uint64(64 - ROW_BITS)).view(np.int64)
        held = recent.take(row, axis=0)
        same = held[:, 0] == keys[0].view(np.int64)
        for k, key in enumerate(keys[1:], 1):
            same &= held[:, k] == key.view(np.int64)
        new = np.flatnonzero(~same)
        return held[:, -1].copy(), new, row[new]

    @staticmethod
    def _short_text(key: int) -> str:
        own = key.to_bytes(8, "little").rstrip(b"\0")
        return (own[1:] if own[0] == 1 else b" " + own).decode()

    def _bulk(self, texts: list[bytes]) -> list[np.ndarray]:
        """Texts that may be cut before every space and line feed; none is empty or has bytes 0 or 1.

        Chunks of up to 9 bytes with a leading space are keyed by the bytes after it, others of up to 7 bytes by
        a byte 1 and themselves, the rest by their bytes."""
        joined = b"".join(texts)
        own = np.frombuffer(joined, np.uint8)
        # Eight bytes from each place on as a number, with zeros after the end.
        eight = np.ndarray((len(joined) + 17,), "<u8", joined + bytes(24), strides=(1,))
        ends = np.cumsum([len(t) for t in texts])
        kind = np.frombuffer(joined.translate(KINDS), np.uint8)
        cut = kind == 3
        cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        cut[0] = True
        cut[ends[:-1]] = True
        at = np.flatnonzero(cut)
        size = np.diff(at, append=len(joined))
        place = np.zeros(len(at), np.int64)
        spaced = own[at] == 32
        n = size - spaced
        short = n <= np.where(spaced, 8, 7)
        short &= n > 0
        spaced, n, s = spaced[short], n[short], (at + spaced)[short]
        key = eight[s] & FIRST[n]
        key = np.where(spaced, key, (key << np.uint64(8)) | np.uint64(1))
        found, new, row = self._seen(self.recent[0], [key])
        distinct, back = np.unique(key[new], return_inverse=True)
        found[new] = self._places(distinct.tolist(), self.short, self._short_text)[back]
        self.recent[0][row] = np.stack([key[new].view(np.int64), found[new]], axis=1)
        place[short] = found
        s = at[~short]
        place[~short] = self._long(joined, eight, s, size[~short])
        count = self.size[place]
        stop = np.cumsum(count)
        ids = self.pool[np.repeat(self.start[place] - stop + count, count) + np.arange(stop[-1])]
        last = np.searchsorted(at, ends) - 1
        return np.split(ids, stop[last][:-1])

    def _long(self, joined: bytes, eight: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the chunks of these sizes, which are keyed by their bytes. Those of up to 16 bytes are two numbers
        each; those that aren't known by them are sorted by a hash and compared with the first of equal hash."""
        place = np.zeros(len(at), np.int64)
        some = np.flatnonzero(size <= 16)
        s, n = at[some], size[some]
        low, high = eight[s] & FIRST[np.minimum(n, 8)], eight[s + 8] & FIRST[np.maximum(n - 8, 0)]
        place[some], new, row = self._seen(self.recent[1], [low, high])
        some, s, n, low, high = some[new], s[new], n[new], low[new], high[new]
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        _, first, back = np.unique(mixed ^ (mixed >> np.uint64(32)), return_index=True, return_inverse=True)
        keys = [joined[a:b] for a, b in zip(s[first].tolist(), (s + n)[first].tolist(), strict=True)]
        found = self._places(keys, self.long, bytes.decode)[back]
        like = first[back]
        same = (low == low[like]) & (high == high[like])
        place[some[same]] = found[same]
        self.recent[1][row[same]] = np.stack([low[same].view(np.int64), high[same].view(np.int64), found[same]], axis=1)
        other = size > 16
        other[some[~same]] = True
        s, n = at[other], size[other]
        longer = [joined[a:b] for a, b in zip(s.tolist(), (s + n).tolist(), strict=True)]
        once = list(dict.fromkeys(longer))
        number = dict(zip(once, self._places(once, self.long, bytes.decode).tolist(), strict=True))
        place[other] = list(map(number.__getitem__, longer))
        return place

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out = [np.zeros(0, np.uint32)] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if self.n > self.bound // 2:
                self._age()
            if held:
                for (k, _), ids in zip(held, self._bulk([t for _, t in held]), strict=True):
                    out[k] = ids
            held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            if self.special and self.special.search(text):
                out[k] = np.array(self.whole(text), np.uint32)
            elif plain(text) and "\0" not in text and "\x01" not in text:
                held.append((k, text.encode()))
                size += len(held[-1][1])
                if size > SLICE:
                    flush()
                    size = 0
            else:
                own = units(text)
                once = list(dict.fromkeys(own))
                number = dict(zip(once, self._places([u.encode() for u in once], self.long, bytes.decode).tolist(), strict=True))
                places = [number[u] for u in own]
                out[k] = np.concatenate([self.pool[self.start[p] : self.start[p] + self.size[p]] for p in places])
        flush()
        return out


#: A string that the pre-tokeniser leaves whole, whatever the version of Unicode.
ONE_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _signs() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next of
    those from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in prints)
    return {b: 256 + k for k, b in enumerate(others)}


SIGNS = _signs()
SPACE = chr(SIGNS[ord(" ")])


def _byte_level(config: dict) -> bool:
    """Whether the tokenizer does nothing but cut texts by the usual pattern and apply BPE to bytes."""
    pre = config["pre_tokenizer"] or {}
    usual = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
    return usual and not any(config.get(k) for k in ("normalizer", "truncation", "padding")) and config["model"].get("type") == "BPE" and not config["model"].get("dropout")


_encoders: dict[str, BulkEncoder] = {}


def library_encoder(path: str) -> BulkEncoder:
    """One per process and tokenizer file; as the library does by default, it reads strings of added tokens as these."""
    keep_tables("tokens", _encoders.clear)
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        added = [t.content for t in tk.get_added_tokens_decoder().values()]

        def full(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for at in range(0, len(strings), 20_000):
                own = strings[at : at + 20_000]
                found = tk.encode(own, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, dtype=np.uint32))
                sizes.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(own)))
            return np.concatenate(ids), np.concatenate(sizes)

        def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Strings of one word go to the library's model at once, the others through all its steps."""
            known, rest, sizes, tokens, cut = list(map(ONE_WORD.fullmatch, strings)), [], [], [], tk.model.tokenize
            for s, is_word in zip(strings, known, strict=True):
                if is_word:
                    found = cut(s.replace(" ", SPACE) if s.isascii() else s.encode().decode("latin-1").translate(SIGNS))
                    sizes.append(len(found))
                    tokens += [t.id for t in found]
                else:
                    sizes.append(0)
                    rest.append(s)
            own, tokens = np.array(sizes, dtype=np.int64), np.array(tokens, dtype=np.uint32)
            if not rest:
                return tokens, own
            more, count = full(rest)
            other = np.array([m is None for m in known])
            own[other] = count
            from_rest = np.repeat(other, own)
            ids = np.empty(len(from_rest), np.uint32)
            ids[from_rest], ids[~from_rest] = more, tokens
            return ids, own

        if not _byte_level(json.loads(tk.to_str())):
            encode = full
        special = re.compile("|".join(map(re.escape, added))) if added else None
        _encoders[path] = BulkEncoder(encode, special=special, whole=lambda text: tk.encode(text, add_special_tokens=False).ids)
    return _encoders[path]
