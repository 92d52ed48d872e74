"""Token ids of whole texts by a public tokenizer file, with pieces encoded once.

A byte-pair tokenizer splits a text into pieces and encodes each piece by itself. For the two split patterns known here the pieces of a
text of plain characters (ASCII and the Latin-1 letters and signs, where every Unicode version agrees) are found by one
regular expression and looked up in a bounded dictionary of encoded pieces; new pieces go through the tokenizer's own model. Any other text, any text
with the content of an added token, and any other kind of tokenizer file, goes through the tokenizer as a whole. The ids are those of the whole text in every case.

A string such as <|endoftext|> inside a text is ordinary text: the tokenizers' description (/opt/tokenizers/README.md) sets encode_special_tokens, so that no
document can forge an end of document. special_as_text=False gives the library's own default instead, where it becomes the special id.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

L, N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
KNOWN = {
    # split with leading spaces, no normaliser
    "spaces": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"),
    # lower case, white space dropped, digits by themselves
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"),
}


def _kind(spec: dict) -> str | None:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("model", {}).get("type") != "BPE" or spec["model"].get("dropout"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaces"
    if pre.get("type") == "Sequence" and norm and norm.get("type") == "Sequence":
        parts, norms = pre["pretokenizers"], [n["type"] for n in norm["normalizers"]]
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            split, level = parts
            own = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if split["pattern"] == {"Regex": own} and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]:
                return "words"
    return None


def _byte_level() -> dict[int, str]:
    """The usual printable stand-ins of bytes: printable Latin-1 for itself, others counted up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LEVEL = _byte_level()


class Encoder:
    """encode(text) gives the ids of a text. special_as_text: whether strings of special tokens are ordinary text."""

    def __init__(self, path: str, most_pieces: int = 400_000, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = _kind(spec) if all(t and not t.isspace() and PLAIN.fullmatch(t) for t in added) else None
        self.find = KNOWN[self.kind].findall if self.kind else None
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        self.pieces: dict[str, bytes] = {}
        self.most = most_pieces

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.find is None or not PLAIN.fullmatch(text) or self.added(text):
            return self.whole(text)
        found = self.find(text.lower() if self.kind == "words" else text)
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        tokenize = self.tokenizer.model.tokenize
        for p in found:
            if p not in known:
                known[p] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(p.encode().decode("latin-1").translate(BYTE_LEVEL))])
        return b"".join(map(known.__getitem__, found))


def path_of(name: str) -> str:
    """Place of a tokenizer file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)
