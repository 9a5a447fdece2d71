"""Byte-level BPE ids of whole texts, a stretch at a time."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken

#: A space between two characters that aren't white space. The pre-tokenizer always starts a token there, so
#: what lies between two such places can be encoded by itself.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that are encoded at a time.
WINDOW = 1 << 16


class ByteBpe:
    """``ids(text)`` gives what the tokenizers library gives for ``json_file`` without special tokens added."""

    def __init__(self, json_file: str, ranks_file: str):
        with open(json_file, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special_ids = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        longest_first = sorted(self.special_ids, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Special strings are cut out first, as the library does; what lies between them is encoded by itself."""
        found = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.special_ids:
                found.append(self.special_ids[part])
            else:
                found.extend(map(self._plain, windows(part)))
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _plain(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """``text`` in stretches of ``size`` characters or a little more, cut only where a token starts anyway."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.cache
def byte_bpe(json_file: str, ranks_file: str) -> ByteBpe:
    """One of these a worker process."""
    return ByteBpe(json_file, ranks_file)


def default_files() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
