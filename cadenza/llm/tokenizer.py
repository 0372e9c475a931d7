"""Token ids, the same as the tokenizers library gives for .json files and sentencepiece for .model files."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

_kept: dict[str, Encoder | Pieces] = {}
_BLANKS = re.compile(r"\s{500}")


def load(path: str) -> tuple[bytes, str]:
    """The file's bytes and their digest: the tokenizer's version."""
    data = Path(path).read_bytes()
    return data, hashlib.sha256(data).hexdigest()


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves, the others for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """ids(text) of a sentencepiece model, without begin and end."""

    normalises, dtype = False, np.uint32

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normal(self, text: str) -> str:
        return text

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


class Encoder:
    """ids(text) as `tokenizers` gives them, without added special tokens.

    Plain byte-level BPE files whose ids are their merge ranks go through tiktoken's merge
    loop, which gives the same ids several times faster (tests compare the two over all code
    points). Other files, texts with special strings and long runs of blanks go through
    tokenizers itself.
    """

    def __init__(self, data: bytes):
        self.slow = Tokenizer.from_str(data.decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast, self.special = None, None
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            letters, special = byte_letters(), {x["content"]: x["id"] for x in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
            order = [model["vocab"][m] for m in merged]
            if order == sorted(order) and len(ranks) == 256 + len(merged):
                # The fixed pattern of byte-level pre-tokenisers.
                pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
                self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
                self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.dtype = np.uint16 if self.slow.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32

        self.normalises = spec["normalizer"] is not None
        self.strings = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"])) if spec["added_tokens"] else None

    def normal(self, text: str) -> str:
        """What the tokenizer makes of a text before it is cut; texts with one normal form have the same ids."""
        if not self.normalises or (self.strings and self.strings.search(text)):
            return text
        return self.slow.normalizer.normalize_str(text)

    def ids(self, text: str) -> list[int]:
        # the search for blanks only spares short texts that can't hold a run: ids don't depend on it
        if self.fast is not None and not (self.special and self.special.search(text)) and (len(text) < 500 or not _BLANKS.search(text)):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # of the extension, which is no Exception
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(data: bytes, version: str) -> Encoder | Pieces:
    """One encoder a worker and version."""
    if version not in _kept:
        _kept[version] = Encoder(data) if data.lstrip()[:1] == b"{" else Pieces(data)
    return _kept[version]
