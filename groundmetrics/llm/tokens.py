"""Token ids of whole texts by a tokenizer file, with a bounded memory of words a worker has met.

A tokenizer never merges across the borders that its own splitting rule sets. Texts are cut at borders that hold for every text
(around runs of Latin letters that end before an ASCII character, and at spaces and line ends), so equal pieces have equal
ids and each is encoded once. Where such a border is not certain the whole text goes to the tokenizer.
"""

from __future__ import annotations

import array
import json
import re
import sys
import types

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # without U+0130, whose lower case is two characters
_RUN = rf"[{_LETTERS}]++(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)"
_BYTE_PIECES = re.compile(rf" ?{_RUN}|[ \n]+(?![^ \n])| ?[^ \n]+|[ \n]+")
_WORD_PIECES = re.compile(rf"{_RUN}|[^ \n\t\r]+")
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_STOPS, _LAST_LETTERS = frozenset(".,;:!?"), frozenset("abcdefghijklmnopqrstuvwxyz")
_OTHER_SPACE = re.compile(r"[^\S \n]")
CACHE_PIECES, CACHED_LENGTH, TOGETHER = 500_000, 48, 1 << 19


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker (functions are shipped by value, their globals do not)."""
    return sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")).__dict__


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 ones as themselves, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + n) for n, b in enumerate(hidden)}


def _splitter(spec: dict):
    """How texts of this tokenizer may be cut: a pattern, and texts that must stay whole; (None, None) if unknown."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
    if not plain:
        return None, None
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not normal:
        special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", ()))
        return _BYTE_PIECES, re.compile(rf"{_OTHER_SPACE.pattern}" + (f"|{special}" if special else ""))
    steps = [n.get("type") for n in normal.get("normalizers", ())]
    first = (split.get("pretokenizers") or [{}])[0]
    drops_space = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", "")
    if steps == ["NFC", "Replace", "Lowercase"] and drops_space:
        return _WORD_PIECES, None
    return None, None


class Encoder:
    """Texts to little-endian uint32 ids as bytes, equal to the tokenizer's own ids of the whole text, without special tokens.

    Null texts must be made empty by the caller; an empty text has no ids. The memory of pieces drops its newer half at
    CACHE_PIECES entries (some 200 bytes each); pieces longer than CACHED_LENGTH are not kept.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pattern, self.whole = _splitter(json.loads(tokenizer_json))
        self.cache: dict[str, bytes] = {}
        self.letters = _byte_letters()

    @classmethod
    def shared(cls, tokenizer_json: str) -> Encoder:
        """One encoder for all tasks of a worker."""
        store, key = worker_store(), ("encoder", hash(tokenizer_json))
        if key not in store:
            store[key] = cls(tokenizer_json)
        return store[key]

    def _plain(self, pieces: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """``_plain`` of pieces. A run of Latin letters is one unit of the splitting rule, so the file's model gets it directly."""
        out: list[bytes | None] = [None] * len(pieces)
        model, rest = self.tokenizer.model, []
        for i, piece in enumerate(pieces):
            if _WORD.fullmatch(piece):
                word = piece.lower() if self.pattern is _WORD_PIECES else piece
                out[i] = array.array("I", [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self._plain([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _chunks(self, text: str) -> list[str] | None:
        """The text cut at single spaces, most chunks being pieces as they are; None if it must be searched for pieces."""
        if self.pattern is _WORD_PIECES:
            return text.split(" ")
        if "  " in text or " \n" in text or "\n " in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
            return None
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are taken some TOGETHER characters at a time, so that only so many pieces are held at once."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return self._plain(texts)
        known, find = self.cache, self.pattern.findall
        if len(known) > CACHE_PIECES:  # the pieces met first are the frequent ones
            for piece in list(known)[CACHE_PIECES // 2 :]:
                del known[piece]
        out, open_, wanted = [], [], set()
        for text in texts:
            if self.whole is not None and self.whole.search(text):
                out.append(self._plain([text]))
                continue
            chunks = self._chunks(text)
            if chunks is None:
                chunks = find(text)
            parts = list(map(known.get, chunks))
            for i in [i for i, p in enumerate(parts) if p is None]:
                chunk = chunks[i]
                if chunk[-1:] in _STOPS and chunk[-2:-1] in _LAST_LETTERS and chunk[:-1] in known and chunk[-1] in known:  # a border of the rule
                    parts[i] = known[chunk[:-1]] + known[chunk[-1]]
                    continue
                pieces = find(chunk)
                missing = [p for p in pieces if p not in known]
                if missing:
                    wanted.update(missing)
                    open_.append((parts, i, pieces))
                else:
                    parts[i] = b"".join([known[p] for p in pieces])
            out.append(parts)
        new = list(wanted)
        known.update(zip(new, self._pieces(new), strict=True))
        for parts, i, pieces in open_:
            parts[i] = b"".join([known[p] for p in pieces])
        for piece in new:
            if len(piece) > CACHED_LENGTH:
                del known[piece]
        return [b"".join(parts) for parts in out]


def read_tokenizer(path: str) -> str:
    """The file's text, read by the driver and shipped to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
