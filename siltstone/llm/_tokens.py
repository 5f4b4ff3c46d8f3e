"""Token ids of a public byte-level BPE, as its `tokenizers` file defines them.

The file's vocabulary is loaded into a faster encoder of the same algorithm;
texts in which the file's special tokens occur are left to the `tokenizers`
library itself. Tests hold the two against each other.
"""

from __future__ import annotations

import json

import numpy as np

END_ID = 0
_loaded: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for raw bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def largest_id(path: str) -> int:
    """The greatest token id that the file defines."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([END_ID, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def document_ids(enc: Encoder, text: str | None) -> np.ndarray:
    ids = enc.ids(text or "")
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")
