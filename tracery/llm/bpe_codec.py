"""BPE encoding and decoding by speculation: propose, verify, and merge exactly only where the proposal fails.

For each new word, greedy longest match proposes tokens. A proposal is the encoding if every token is what merging its
own characters gives and every adjacent pair is compatible, that is, no merge would have crossed the boundary between
them: for an end ``a`` of the left token and a start ``b`` of the right one, both present at the same time of the
merging, (a, b) is not a merge that comes before the two grow on. The pairs of all new words of a batch are tested
together, in numpy. Words with an incompatible pair are merged exactly, by rank, with a heap.

The vocabulary file's path is a parameter; both word-end and plain byte-level vocabularies are understood, with the
parts of the file format that they use (NFC, Replace and Lowercase normalizers, Split and ByteLevel pre-tokenizers).

Defined cases: a null text is empty and has no tokens; texts may hold the strings of special tokens, which are then
those tokens; repeated and extra columns and an empty table are no exception.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from tracery.llm.common import map_texts, on_executor, shipped, texts

#: Oniguruma's ``\s``.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that ``regex`` knows and Unicode 16, which the tokenizers library follows, does not.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Lower case of letters of Unicode 16 and 17 that Python does not know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Words kept with their encodings, in each Python worker, and as many of the generation before them.
CACHED = 200_000
#: Verdicts on token pairs kept, and the longest word merged beside others rather than alone.
PAIRS = 1_000_000
WIDE = 48
NEVER = np.iinfo(np.int32).max


def _spelt_out(pattern: str, letters: str, numbers: str) -> str:
    """The pattern with ``\\s``, ``\\p{L}`` and ``\\p{N}`` as the vocabulary's own library understands them."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        if pattern[k] == "\\":
            known = {r"\s": SPACE, r"\p{L}": letters, r"\p{N}": numbers}
            name = next((x for x in known if pattern.startswith(x, k)), None)
            if name:
                out.append(known[name] if inside else f"[{known[name]}]")
                k += len(name)
            elif pattern.startswith(r"\S", k) and not inside:
                out.append(f"[^{SPACE}]")
                k += 2
            else:
                out.append(pattern[k : k + 2])
                k += 2
        else:
            inside = pattern[k] == "[" or inside and pattern[k] != "]"
            out.append(pattern[k])
            k += 1
    return "".join(out)


_later_set = frozenset(chr(c) for x in LATER.split() for ends in [[int(y, 16) for y in x.split("-")]] for c in range(ends[0], ends[-1] + 1))
_later = regex.compile("[" + "".join(sorted(_later_set)) + "]")
_beyond = re.compile("[^\0-\uffff]+")


def _ranges(kind: str) -> str:
    """The characters of a Unicode category up to U+FFFF, as the inside of a character class."""
    points = [ord(c) for c in regex.findall(rf"\p{{{kind}}}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))) if c not in _later_set]
    out, start = [], None
    for c, following in zip(points, [*points[1:], None], strict=True):
        start = c if start is None else start
        if following != c + 1:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(c)) if c > start else ""))
            start = None
    return "".join(out)


class Splitter:
    """Finds words. The standard library's engine, given the categories as plain ranges, is twice as fast."""

    def __init__(self, pattern: str):
        self.near = re.compile(_spelt_out(pattern, _ranges("L"), _ranges("N")))
        self.any = regex.compile(_spelt_out(pattern, r"\p{L}", r"\p{N}"))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.near.findall(text)
        high = _beyond.findall(text)
        if not high:
            return self.near.findall(text)
        if _later_set.isdisjoint("".join(high)):
            return self.any.findall(text)
        return [text[m.start() : m.end()] for m in self.any.finditer(_later.sub("\uffff", text))]  # neither letter nor number


_capitals = regex.compile("[" + "".join(map(chr, LOWER)) + "]")


def _lower(text: str) -> str:
    """Lower case character by character: no final sigma."""
    if text.isascii():
        return text.lower()
    text = text.replace("Σ", "σ").lower()
    return text.translate(LOWER) if _capitals.search(text) else text


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next unused from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None
        self.normalizers = self._normalizers(spec.get("normalizer"))
        self.pattern = self._pattern(spec["pre_tokenizer"])
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.stand_in = {b: c for b, c in enumerate(byte_characters())}
        self.byte_of = {c: b for b, c in self.stand_in.items()}
        self._merges(model["merges"])
        size = max([*self.vocab.values(), *special.values()]) + 1
        self.token: list[str] = [""] * size
        for t, i in [*self.vocab.items(), *special.items()]:
            self.token[i] = t
        if self.byte_level_decoder:
            raw = lambda t: bytes(self.byte_of[c] for c in t)
            self.piece = [t.encode() if t in special else raw(t) for t in self.token]
        else:
            self.piece = [f"{t} ".encode() for t in self.token]
        self.id_bytes = [int(i).to_bytes(4, "little") for i in range(size)]
        self.trie: dict = {}
        for t, i in self.vocab.items():
            node = self.trie
            for c in self._marked(t):
                node = node.setdefault(c, {})
            node[""] = i
        self.sound: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.word_ids: dict[str | int, bytes] = {}
        self.older: tuple[dict[str | int, bytes], dict[str | int, bytes]] = {}, {}
        self.word_text: dict[str | int, bytes] = {}
        self.exactly_merged = self.proposed = 0

    # --- the file's parts

    @staticmethod
    def _normalizers(spec: dict | None) -> list:
        found = []
        for part in (spec or {}).get("normalizers", [spec] if spec else []):
            if part["type"] == "NFC":
                found.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
            elif part["type"] == "Replace":
                if (part["pattern"]["Regex"], part["content"]) == (r"\s+", " "):  # single spaces are what they become
                    runs = re.compile(f"[{SPACE.replace(' ', '')}][{SPACE}]*| [{SPACE}]+")
                    found.append(lambda t, p=runs: p.sub(" ", t))
                    continue
                pattern = regex.compile(_spelt_out(part["pattern"]["Regex"], r"\p{L}", r"\p{N}"))
                found.append(lambda t, p=pattern, c=part["content"].replace("\\", r"\\"): p.sub(c, t))
            elif part["type"] == "Lowercase":
                found.append(_lower)
            else:
                raise ValueError(f"normalizer {part['type']} is not known")
        return found

    @staticmethod
    def _pattern(spec: dict) -> Splitter:
        for part in spec.get("pretokenizers", [spec]):
            if part["type"] == "Split":
                if part["behavior"] != "Removed" or not part["invert"]:
                    raise ValueError("only splits that keep the matches are known")
                return Splitter(part["pattern"]["Regex"])
            if part["type"] == "ByteLevel" and part["use_regex"] and not part["add_prefix_space"]:
                return Splitter(BYTE_LEVEL)
        raise ValueError("the pre-tokenizer is not known")

    def _merges(self, merges: list) -> None:
        """Ranks by pair, and for each token the merge that makes it."""
        n = max(self.vocab.values()) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = np.full(n, -1, np.int32)  # rank of the merge that makes the token; -1 for characters
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[x, y] = (k, z)
            if self.made[z] < 0:
                self.made[z], self.left[z], self.right[z] = k, x, y
        keys = np.array([x << 32 | y for x, y in self.rank], dtype=np.int64)
        ranks = np.array([k for k, _ in self.rank.values()], dtype=np.int64)
        self.result = np.array([z for _, z in self.rank.values()], dtype=np.int64)[np.argsort(ranks)]
        bits = max(12, int(np.ceil(np.log2(len(keys) * 16 + 1))))
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, NEVER, np.int64)
        self.probes = 0
        while len(keys):  # each round places one key of every free slot
            at = self._slot(keys) + self.probes
            free = np.flatnonzero(self.slot_key[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            keys, ranks = np.delete(keys, put), np.delete(ranks, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NEVER where there is none: a table with a few open places for each key."""
        keys = a << 32 | b
        at = self._slot(keys)
        found = np.where(self.slot_key[at] == keys, self.slot_rank[at], NEVER)
        for k in range(1, self.probes):
            found = np.where(self.slot_key[at + k] == keys, self.slot_rank[at + k], found)
        return found

    def _marked(self, token: str) -> str:
        """The token with its word end, if it has one, as a single character."""
        return token[: -len(self.suffix)] + "" if self.suffix and token.endswith(self.suffix) and token != self.suffix else token

    # --- exact merging

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's characters, the last with the word end."""
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def merge(self, ids: list[int]) -> list[int]:
        """Merging by rank, then from the left, with a heap over a linked list."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.rank]
        heap = [(rank, k, made, pair) for rank, made, k, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made, pair = heapq.heappop(heap)
            r = after[k]
            if ids[k] != pair[0] or r >= n or ids[r] != pair[1]:
                continue
            ids[k], ids[r], after[k] = made, -1, after[r]
            if after[r] < n:
                before[after[r]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (p := (ids[left], ids[after[left]])) in self.rank:
                    rank, new = self.rank[p]
                    heapq.heappush(heap, (rank, left, new, p))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """``merge`` of many words side by side: each round makes the first merge of least rank in every word."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for k, ids in enumerate(words):
            if len(ids) > WIDE:
                out[k] = self.merge(ids)
            else:
                short.append(k)
        short.sort(key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            own = short[at : at + 4096]
            width = len(words[own[-1]])
            ids = np.full((len(own), width + 1), -1, np.int64)
            for row, k in enumerate(own):
                ids[row, : len(words[k])] = words[k]
            ranks = np.full((len(own), width + 1), NEVER, np.int64)
            there = ids[:, 1:] >= 0
            ranks[:, :-1][there] = self.pair_ranks(ids[:, :-1][there], ids[:, 1:][there])
            columns, live = np.arange(width + 1), np.arange(len(own))
            done = np.empty_like(ids)
            while len(live):
                place = ranks.argmin(axis=1)
                rows = np.arange(len(live))
                least = ranks[rows, place]
                ended = least == NEVER
                if ended.any():
                    done[live[ended]] = ids[ended]
                    live, ids, ranks, place, least = (v[~ended] for v in (live, ids, ranks, place, least))
                    rows = np.arange(len(live))
                    if not len(live):
                        break
                source = np.minimum(columns + (columns > place[:, None]), width)
                ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
                ids[rows, place] = self.result[least]
                for c in (place - 1, place):
                    ok = (c >= 0) & (c < width)
                    r, c = rows[ok], c[ok]
                    a, b = ids[r, c], ids[r, c + 1]
                    ranks[r, c] = np.where(b >= 0, self.pair_ranks(a, b), NEVER)
            for row, k in enumerate(own):
                out[k] = done[row][done[row] >= 0].tolist()
        return out

    # --- speculation

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match along a trie; None where it runs into a dead end."""
        text = word + "\ue000" if self.suffix else word
        size = len(text)
        last = size - 1 if self.suffix else -1  # the word end can't stand alone
        out, at, root = [], 0, self.trie
        while at < size:
            node, found, k = root, None, at
            while k < size:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                own = node.get("")
                if own is not None and k != last:
                    found, end = own, k
            if found is None:
                return None
            out.append(found)
            at = end
        return out

    def _check_sound(self, tokens: set[int]) -> None:
        """Which tokens merging their own characters gives."""
        own = []
        for t in tokens:
            text = self.token[t]
            ends = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            plain = text[: -len(self.suffix)] if ends else text
            own.append(self.symbols(plain) if ends or not self.suffix else [self.vocab[c] for c in plain])
        self.sound.update((t, m == [t]) for t, m in zip(tokens, self.merge_all(own), strict=True))

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of sound tokens, whether no merge crosses the boundary between them.

        The time of the merging runs backwards: both sides start whole, and the one that was made later is taken
        apart, until both are characters. ``until``: the rank up to which the present two ends stand side by side; a
        merge of them of that very rank goes first if it lies further left than the one that made the right end grow.
        """
        a, b = x.astype(np.int64), y.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        until = np.full(len(a), NEVER, np.int64)  # crossing merges below this rank happen
        live = np.arange(len(a))
        while len(live):
            p, q = a[live], b[live]
            crosses = self.pair_ranks(p, q) < until[live]
            good[live[crosses]] = False
            made_p, made_q = self.made[p].astype(np.int64), self.made[q].astype(np.int64)
            live, p, q, made_p, made_q = (v[~crosses & ((made_p >= 0) | (made_q >= 0))] for v in (live, p, q, made_p, made_q))
            apart = made_p >= made_q  # of equal merges the left one comes first, so time runs back over the right one first
            apart &= made_p != made_q
            a[live] = np.where(apart, self.right[p], p)
            b[live] = np.where(apart, q, self.left[q])
            until[live] = np.where(apart, made_p, made_q + 1)
        return good

    def learn(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The encodings of new words, in stand-in characters."""
        words = list(words)
        proposals = [self.propose(w) for w in words]
        self.proposed += len(words)
        used = {t for p in proposals if p for t in p}
        self._check_sound(used.difference(self.sound))
        known, sound = self.pairs, self.sound
        if len(known) > PAIRS:
            known.clear()
        fresh = list({x << 32 | y for p in proposals if p for x, y in zip(p, p[1:])}.difference(known))
        keys = np.array(fresh, dtype=np.int64)
        known.update(zip(fresh, self.compatible(keys >> 32, keys & 0xFFFFFFFF).tolist(), strict=True))
        bad_tokens = {t for t in used if not sound[t]}
        failing = []
        for k, p in enumerate(proposals):
            if p is None or bad_tokens and not bad_tokens.isdisjoint(p):
                failing.append(k)
                continue
            x = p[0]
            for y in p[1:]:
                if not known[x << 32 | y]:
                    failing.append(k)
                    break
                x = y
        self.exactly_merged += len(failing)
        for k, ids in zip(failing, self.merge_all([self.symbols(words[k]) for k in failing]), strict=True):
            proposals[k] = ids
        return dict(zip(words, proposals, strict=True))

    # --- texts

    def split(self, text: str) -> list[str | int]:
        """The words of a text, in order; special tokens as their ids."""
        parts = [text]
        if self.split_special and any(s in text for s in self.special):
            parts = [p for p in self.split_special.split(text) if p]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            for step in self.normalizers:
                part = step(part)
            out += self.pattern(part)
        return out

    def _learn_words(self, new: set[str | int]) -> None:
        """Put new words, as they stand in texts, into the tables of known words."""
        stand_in, ids, piece = self.stand_in, self.id_bytes, self.piece
        table = {w: [w] if isinstance(w, int) else "".join([stand_in[b] for b in w.encode()]) for w in new}
        learnt = self.learn({t for t in table.values() if isinstance(t, str)})
        for w, t in table.items():
            own = learnt[t] if isinstance(t, str) else t
            self.word_ids[w] = b"".join([ids[i] for i in own])
            self.word_text[w] = b"".join([piece[i] for i in own])

    def encode_batch(self, data: list[str], decoded: bool = True) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text if asked for) of each text."""
        if len(self.word_ids) > CACHED:  # words still in use come back from the older generation
            self.older = self.word_ids, self.word_text
            self.word_ids, self.word_text = {}, {}
        split = [self.split(t) for t in data]
        new: set[str | int] = set()
        for words in split:
            new.update(set(words).difference(self.word_ids))
        for w in new & self.older[0].keys():
            self.word_ids[w], self.word_text[w] = self.older[0][w], self.older[1][w]
            new.remove(w)
        if new:
            self._learn_words(new)
        ids, text = self.word_ids.__getitem__, self.word_text.__getitem__
        out = []
        for words in split:
            whole = b"".join(map(text, words)) if decoded else b""
            if self.byte_level_decoder:
                whole = whole.decode("utf-8", "replace").encode()
            out.append((b"".join(map(ids, words)), whole if self.byte_level_decoder else whole[:-1]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included."""
        text = b"".join([self.piece[i] for i in ids])
        return text.decode("utf-8", "replace") if self.byte_level_decoder else text[:-1].decode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, read once in each process."""
    if path not in _codecs:
        _codecs[path] = Codec(on_executor(path))
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens of each whole text as an array, and the text that they decode to."""
    shipped(docs.sparkSession, path)

    def each(data: list[bytes]) -> dict[str, list]:
        found = codec(path).encode_batch([x.decode() for x in data])
        return {"ids": [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], "decoded": [t.decode() for _, t in found]}

    return map_texts(texts(docs), each, "ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the same encoding, of which only digests leave the worker."""
    shipped(docs.sparkSession, path)

    def each(data: list[bytes]) -> dict[str, list]:
        found = codec(path).encode_batch([x.decode() for x in data])
        return {
            "n_tokens": [len(i) // 4 for i, _ in found],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in found],
            "decoded_sha256": [hashlib.sha256(t).hexdigest() for _, t in found],
        }

    return map_texts(texts(docs), each, "n_tokens long, ids_sha256 string, decoded_sha256 string")
