"""Byte-pair encoders built from a tokenizer's published JSON file.

The file's place is a parameter everywhere; its bytes travel to the executors in
a broadcast variable, so executors need no file of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
from tokenizers import Tokenizer

#: Entries that each of a memo's two generations may hold, and the longest pre-token that becomes one:
#: with at most 64 characters and their ids an entry takes 250 bytes as a rule and 700 at worst.
MEMO_ENTRIES = 100_000
MEMO_LENGTH = 64


def read_vocabulary(path: str) -> tuple[bytes, str]:
    """The file's bytes and their SHA-256, which names the tokenizer's version."""
    with open(path, "rb") as f:
        data = f.read()
    return data, hashlib.sha256(data).hexdigest()


def id_dtype(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < (1 << 16) - 1 else "<u4")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def library(data: bytes) -> Tokenizer:
    """The library's tokenizer, without truncation or padding."""
    tok = Tokenizer.from_str(data.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    return tok


class ByteLevelCounter:
    """Token counts of a byte-level BPE file.

    The merge table is handed to a rank-based encoder, which gives the library's
    ids several times faster.  Characters outside the blocks below, where the two
    regex engines' Unicode tables might differ, send a text to the library.
    """

    #: Fixed value: the pre-tokenizer's split pattern of byte-level BPE files.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _OTHER = re.compile("[^\t-\r -~\xa0-ɏ‐-‧‰-⁞₠-₿]")

    def __init__(self, data: bytes):
        spec = json.loads(data)
        pre = spec["pre_tokenizer"] or {}
        self.tok = library(data)
        self.core = None
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if plain and spec["model"]["type"] == "BPE" and not spec["model"].get("end_of_word_suffix"):
            of = byte_alphabet()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.core = tiktoken.Encoding("from-json", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(self, text: str) -> int:
        if self.core is not None and not self._OTHER.search(text):
            try:
                return len(self.core.encode(text, allowed_special="all"))
            except BaseException as e:  # the regex engine's limits come as ValueError or as a panic outside Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return len(self.tok.encode(text, add_special_tokens=False).ids)


class _Memo(dict):
    """A bounded memo of two generations: when the young one is full, it becomes the old one."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.entries, self.old = entries, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def absent(self, keys: set) -> set:
        """Which of ``keys`` must be computed; those of the old generation are brought back."""
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        out = keys.difference(self)
        back = out.intersection(self.old)
        self.update(zip(back, map(self.old.__getitem__, back)))
        return out - back


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def runs(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``flat[first[i] : first[i] + n[i]]`` one after another."""
    return flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class WordEndBPE:
    """BPE with word ends (lower-casing, white space dropped), by forced boundaries.

    A byte pair that lies inside no vocabulary token can never be merged over, so
    each such pair is a certain cut.  A pre-token's fragments between cuts are
    encoded independently and their ids concatenated.  White space is such a cut
    for whole texts: no pre-token holds any, so a text is the concatenation of its
    white-space-separated chunks.  Of a batch each distinct chunk is cut into
    pre-tokens once and each distinct pre-token encoded once; those are memoised.

    Normalising and pre-tokenising follow the library: for chunks of ASCII and
    precomposed Latin letters by the rules below, for all others by calling the
    library's own normalizer and pre-tokenizer on the chunk.  A file with another
    normaliser or splitter has no such rules: its texts go to the library whole.
    """

    END, CUT = b"\0", b"\1"  # stand for the word end and a cut; chunks that hold them go to the library
    SUFFIX = "</w>"
    # The normaliser and splitter that the rules below follow.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    #: White space as the pre-tokenizer's regex engine has it.
    _WS = re.compile("[\t-\r \x85\xa0  -     　]+")
    _WIDE_WS = re.compile("[\x85\xa0  -     　]")  # beyond ASCII
    _PLAIN = re.compile("[\n!-~À-ÖØ-öø-įı-ž]*")
    _PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ž]+|[0-9]|[!-/:-@\\[-`{-~]+|\n")

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != self.SUFFIX:
            raise ValueError("a BPE file with word ends is needed")
        self.data = data
        self.bytes_of = byte_alphabet()
        self.known = spec["normalizer"] == self.NORMALIZER and spec["pre_tokenizer"] == self.SPLITTER
        self.joins = spec.get("decoder") is None
        self.names = {i: t for t, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in special.items()}
        end, cut = self.END[0], self.CUT[0]
        ranks: dict[bytes, int] = {}
        inside: set[tuple[int, int]] = set()
        for name, i in model["vocab"].items():
            if name in special:
                continue
            word_end = name.endswith(self.SUFFIX) and len(name) > len(self.SUFFIX)
            raw = bytes(self.bytes_of[c] for c in (name[: -len(self.SUFFIX)] if word_end else name))
            if end in raw or cut in raw:
                continue
            inside.update(zip(raw, raw[1:]))
            ranks[raw + self.END * word_end] = i
        table = np.zeros((256, 256), bool)
        table[tuple(np.array(sorted(inside)).T)] = True
        table[:, end] = True  # the end belongs to what stands before it; nothing follows it in a token
        table[end, :] = False
        self.inside = table
        self.special = special
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # a cut, the end alone and a mark behind each pre-token get numbers of their own
        top = max(self.names) + 1
        self._stop, single = top + 2, {self.END: top, self.CUT: top + 1, b"\n" + self.END: top + 2}
        self._core = tiktoken.Encoding("word-end", pat_str="[^\1]+", mergeable_ranks=ranks | single, special_tokens={})._core_bpe
        self.dtype = id_dtype(top - 1)
        self.memo = _Memo()

    @cached_property
    def tok(self) -> Tokenizer:
        """The library's tokenizer, built when a chunk first needs it."""
        return library(self.data)

    def _pieces(self, chunk: str) -> list[str]:
        """The library's pre-tokens of a chunk that the plain rule does not cover."""
        norm = self.tok.normalizer.normalize_str(chunk)
        of = self.bytes_of
        return [bytes(of[c] for c in p).decode("utf-8") for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm) if p]

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Where fragments begin, in bytes of pre-tokens that each end in END; never within a character."""
        return np.flatnonzero(~self.inside[raw[:-1], raw[1:]] & (raw[1:] & 0xC0 != 0x80)) + 1

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token: mark its end, cut at forced boundaries, encode all fragments at once."""
        raw = np.frombuffer("\0\n\0".join([*pieces, ""]).encode("utf-8"), np.uint8)
        marked = np.insert(raw, self.cuts(raw), self.CUT[0]).tobytes().decode("utf-8")
        ids = np.frombuffer(self._core.encode_to_tiktoken_buffer(marked, set()), np.uint32)
        width = self.dtype.itemsize
        stops = np.flatnonzero(ids == self._stop) * width
        held = ids.astype(self.dtype).tobytes()
        return list(map(held.__getitem__, map(slice, [0, *(stops + width).tolist()], stops.tolist())))

    def _known(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of these distinct pre-tokens, among others."""
        missing = list(self.memo.absent(set(pieces)))
        if not missing:
            return self.memo
        fresh = dict(zip(missing, self._learn(missing)))
        if max(map(len, missing)) <= MEMO_LENGTH:
            self.memo.update(fresh)
            return self.memo
        self.memo.update((p, ids) for p, ids in fresh.items() if len(p) <= MEMO_LENGTH)
        return {p: fresh[p] if p in fresh else self.memo[p] for p in pieces}

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each chunk) of distinct chunks, in order."""
        whole, special, fixed = self._PLAIN.fullmatch, self.special, {}
        joined = "\n".join([*chunks, ""])
        if whole(joined) and special.keys().isdisjoint(chunks):
            pieces = self._PIECE.findall(joined.lower())
        else:
            pieces = []
            for i, c in enumerate(chunks):
                if c in special:
                    fixed[i] = np.array([special[c]], self.dtype)
                elif whole(c):
                    pieces += self._PIECE.findall(c.lower())
                elif "\0" in c or "\1" in c:
                    fixed[i] = np.array(self.tok.encode(c, add_special_tokens=False).ids, self.dtype)
                else:
                    pieces += self._pieces(c)
                pieces.append("\n")
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        at, names = coded.indices.to_numpy(), strings(coded.dictionary)
        ends = np.flatnonzero(at == names.index("\n")) if names else np.zeros(0, np.int64)
        known = self._known([p for p in names if p != "\n"])
        found = [known[p] if p != "\n" else b"" for p in names]
        n = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first = np.cumsum(n) - n
        flat = runs(np.frombuffer(b"".join(found), self.dtype), first[at], n[at])
        before = np.concatenate([[0], np.cumsum(n[at])])
        count = np.diff(before[np.concatenate([[0], ends + 1])]) if len(ends) else np.zeros(0, np.int64)
        if fixed:
            parts = np.split(flat, np.cumsum(count)[:-1])
            for i, ids in fixed.items():
                parts[i], count[i] = ids, len(ids)
            flat = np.concatenate(parts)
        return flat, count

    def chunks(self, text: str) -> list[str]:
        """The chunks between white space and special strings, in order."""
        parts = self._specials.split(text) if self._specials is not None else [text]
        return [c for p in parts for c in ([p] if p in self.special else self._WS.split(p)) if c]

    def _spaced(self, text: str) -> str:
        """The text with ASCII white space alone between its chunks."""
        if (text.isascii() or not self._WIDE_WS.search(text)) and (self._specials is None or not self._specials.search(text)):
            return text
        return " ".join(self.chunks(text))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each text)."""
        split = pa.compute.ascii_split_whitespace(pa.array([self._spaced(t) for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        flat, n = self._of_chunks(strings(coded.dictionary))
        before = np.concatenate([[0], np.cumsum(n[at])])
        return runs(flat, (np.cumsum(n) - n)[at], n[at]), np.diff(before[split.offsets.to_numpy()])

    def encode_raw(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned numbers of ``dtype``."""
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), self.dtype).tolist()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode_raw`` of each text, encoding all their pre-tokens together."""
        if not self.known:
            return [np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
        flat, n = self._encode(texts)
        held, ends = flat.tobytes(), np.cumsum(n) * self.dtype.itemsize
        return list(map(held.__getitem__, map(slice, [0, *ends.tolist()], ends.tolist())))

    def decode(self, ids) -> str:
        """As the library does for a file without a decoder: names joined by a space."""
        names = self.names
        return " ".join([names[i] for i in ids]) if self.joins else self.tok.decode(list(ids), skip_special_tokens=False)


_BUILT: dict[tuple[str, str], object] = {}


def encoder(kind, version: str, data: bytes):
    """One encoder for each kind and file in a worker process."""
    key = (kind.__name__, version)
    if key not in _BUILT:
        _BUILT[key] = kind(data)
    return _BUILT[key]
