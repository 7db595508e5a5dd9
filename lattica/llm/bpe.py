"""Byte-level BPE encoding and decoding with a pair occurrence index.

A worker reads its partition in slices. The pieces of all texts of a slice that it hasn't met before are merged
together: every adjacent pair of symbols maps to the list of all its positions in these pieces, the active pairs are
taken in ascending rank, each pair is merged at all its positions at once, and the lists of the pairs this makes are
updated. Pieces met before are looked up, so each of a partition's pieces enters an index once, while it is remembered.

Nulls count as empty texts; empty texts give no ids, empty tables no rows. Texts are never cut, however long. Rows are
independent, so repeated rows give repeated results; of pairs that could be merged at the same place the lower rank
goes first, and of equal pairs the first from the left. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import map_slices

#: Pieces in each of the two generations whose ids a worker remembers.
PIECES = 300_000
#: How byte-level BPE splits a text into pieces, letters and digits left open.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 for itself, the others
    shifted to 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def splitters(tokenizer_path: str) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The split pattern for usual texts, that for texts with doubtful characters, and a pattern that finds these: the
    installed tokenizers library may lag behind the regex module's Unicode version, so characters that the standard
    library doesn't know as letters or digits either are asked one by one."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]"))
    both = []
    for kind, lead in (("L", "a"), ("N", "1")):
        doubtful = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind]
        both += [ord(c) for c in doubtful if len(split(lead + c)) > 1]
    if not both:
        return plain, plain, None
    cut = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(sorted(both)))
    careful = SPLIT.format(L=rf"(?:\p{{L}}(?<![{cut}]))", N=rf"(?:\p{{N}}(?<![{cut}]))", O=rf"(?:[^\s\p{{L}}\p{{N}}]|[{cut}])")
    return plain, regex.compile(careful), regex.compile(f"[{cut}]")


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: ranks of pairs of ids, bytes of ids, added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, of_char = spec["model"]["vocab"], byte_alphabet()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: bytes(of_char[c] for c in t) for t, i in ids.items() if all(c in of_char for c in t)}
        self.first = [0] * 256
        for c, b in of_char.items():
            self.first[b] = ids[c]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.digits = [str(i) for i in range(1 + max(self.bytes_of))].__getitem__
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.plain, self.split, self.doubtful = splitters(path)
        #: Ids of the pieces seen lately, and of those seen before them.
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    # -- encoding -----------------------------------------------------------------------------------------------

    def merge(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece: one pair occurrence index over all of them."""
        ranks, first = self.ranks, self.first
        raw = [p.encode() for p in pieces]
        symbols = [first[b] for r in raw for b in r]
        n = len(symbols)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        starts, at = [], 0
        for r in raw:
            starts.append(at)
            preceding[at] = -1
            at += len(r)
            following[at - 1] = -1
        where: dict[tuple[int, int], list[int]] = {}
        for k, pair in enumerate(zip(symbols, symbols[1:])):
            if following[k] >= 0:
                if pair in where:
                    where[pair].append(k)
                elif pair in ranks:
                    where[pair] = [k]
        active = [(*ranks[p], p) for p in where]
        heapq.heapify(active)
        while active:
            _, made, pair = heapq.heappop(active)
            left, right = pair
            spots = where.pop(pair)
            spots.sort()
            new: dict[tuple[int, int], list[int]] = {}
            for k in spots:
                m = following[k]
                if symbols[k] != left or m < 0 or symbols[m] != right:
                    continue  # an earlier merge took one of the two
                symbols[k], symbols[m] = made, -1
                following[k] = after = following[m]
                if after >= 0:
                    preceding[after] = k
                    new.setdefault((made, symbols[after]), []).append(k)
                if (before := preceding[k]) >= 0:
                    new.setdefault((symbols[before], made), []).append(before)
            for made_pair, more in new.items():
                if made_pair in where:
                    where[made_pair] += more
                elif made_pair in ranks:
                    where[made_pair] = more
                    heapq.heappush(active, (*ranks[made_pair], made_pair))
        out = []
        for at in starts:
            ids = [symbols[at]]
            while (at := following[at]) >= 0:
                ids.append(symbols[at])
            out.append(tuple(ids))
        return out

    def pieces(self, text: str) -> list[str]:
        split = self.plain if text.isascii() or self.doubtful is None or not self.doubtful.search(text) else self.split
        if not any(t in text for t in self.added):
            return split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.added_split.split(text)):
            out += [part] if k % 2 else split.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, as the tokenizers library gives them with add_special_tokens=False."""
        if len(self.known) > PIECES:
            self.known, self.before = {}, self.known
        known, before, split = self.known, self.before, [self.pieces(t or "") for t in texts]
        for t, i in self.added.items():
            known[t] = (i,)
        missing = set().union(*split).difference(known)
        known.update((p, before[p]) for p in missing if p in before)
        new = sorted(missing.difference(before))
        known.update(zip(new, self.merge(new), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, ps))) for ps in split]

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; bytes that are no UTF-8 become U+FFFD; unknown ids are left out."""
        got = self.bytes_of
        try:
            raw = b"".join(map(got.__getitem__, ids))
        except KeyError:
            raw = b"".join([got[i] for i in ids if i in got])
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) for every row."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {key: rows[key], "ids": vocabulary(path).encode(rows[text])}

    return map_slices(df, f"`{key}` {kind}, ids array<int>", work, [key, text])


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) for every row of ids; null ids give null."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        return {key: rows[key], "text": [None if x is None else v.decode(x) for x in rows[ids]]}

    return map_slices(df, f"`{key}` {kind}, text string", work, [key, ids])


def encode_checked(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, same) for every row; same: the ids decode to the text."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        place = {t: k for k, t in enumerate(dict.fromkeys(rows[text]))}  # copies that stand together are encoded once
        ids = v.encode(list(place))
        same = [v.decode(x) == (t or "") for x, t in zip(ids, place, strict=True)]
        at = [place[t] for t in rows[text]]
        return {key: rows[key], "n_tokens": [len(ids[k]) for k in at], "ids": [ids[k] for k in at], "same": [same[k] for k in at]}

    return map_slices(df, f"`{key}` {kind}, n_tokens long, ids array<int>, same boolean", work, [key, text])


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, so that ids don't leave the worker."""
    kind = dict(df.dtypes)[key]

    def work(rows: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        ids = v.encode(rows[text])
        return {
            key: rows[key],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(",".join(map(v.digits, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids],
        }

    return map_slices(df, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work, [key, text])
