"""Token ids of whole texts by the tokenizers library.

Tokenizers that drop white space and never join over it encode each word by
itself.  For those, every distinct word of a batch is encoded once and kept in
a bounded cache of the Python worker; the ids of the texts are then gathered
with numpy.  Any other tokenizer encodes the texts as they are.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import words_of

#: Words that a worker keeps (about 200 bytes each).
CACHE_WORDS = 500_000

# The form of a tokenizer whose words can be encoded alone.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Words whose parts are plain to see: ASCII without the
# apostrophe, and the Latin-1 letters that lower-casing keeps in that range.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself where it is
    a visible Latin-1 character, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [])
        self.by_word = (
            norm.get("normalizers") == _NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and not any(re.search(r"\s", t) for t in self.added)
        )
        self.letters = _byte_letters()
        self.cache: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        model, out, rest = self.tokenizer.model, [b""] * len(words), []
        for k, raw in enumerate(words):
            word = raw.decode("utf-8")
            if _PLAIN.fullmatch(word) and not any(t in word for t in self.added):
                ids: list[int] = []
                for part in _PARTS.findall(word.lower()):
                    if not part.isascii():
                        part = part.encode("utf-8").decode("latin-1").translate(self.letters)
                    ids += [t.id for t in model.tokenize(part)]
                out[k] = np.array(ids, "<u4").tobytes()
            else:
                rest.append(k)
        for k, ids in zip(rest, self._whole([words[k].decode("utf-8") for k in rest]), strict=True):
            out[k] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: pa.Array | pa.ChunkedArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with ``end_id`` after it, and
        where each text's ids start, with the end."""
        n = len(text)
        if self.by_word:
            words = words_of(text)
            codes, distinct = words.coded()
            known = [self.cache.get(w) for w in distinct]
            new = [k for k, ids in enumerate(known) if ids is None]
            for k, ids in zip(new, self._words([distinct[k] for k in new]), strict=True):
                known[k] = ids
                if len(self.cache) < CACHE_WORDS:
                    self.cache[distinct[k]] = ids
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat = np.frombuffer(b"".join(known), "<u4")
            begin = np.cumsum(size) - size
            lens = size[codes]
            to = np.cumsum(lens) - lens
            ids = flat[np.repeat(begin[codes] - to, lens) + np.arange(int(lens.sum()))]
            at = np.r_[to, len(ids)][words.first]
        else:
            each = self._whole([t or "" for t in text.to_pylist()])
            at = np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)].astype(np.int64)
            ids = np.fromiter((i for x in each for i in x), "<u4", int(at[-1]))
        if end_id is None:
            return ids, at
        out = np.full(len(ids) + n, end_id, "<u4")
        body = np.ones(len(out), bool)
        at = at + np.arange(n + 1)
        body[at[1:] - 1] = False
        out[body] = ids
        return out, at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(path)
