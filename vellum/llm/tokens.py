"""Token ids of texts, the same as the tokenizers library gives for byte_bpe_50k.json.

The same merges lie beside the tokenizer file as ranks, and are read by a library that encodes a text
several times as fast. Texts that hold a special token's string, and those with a run of white space so long
that that library gives up, go through the tokenizers library itself, and so does everything when there is no rank file.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(text) -> ids as uint32; made once in each worker."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or default_path()
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks, self.ranked = re.sub(r"\.json$", ".tiktoken", path), None
        if os.path.exists(ranks):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def _plain(self, text: str) -> bool:
        return self.ranked is not None and not any(s in text for s in self.special)

    def _ids(self, text) -> list[int]:
        text = text if isinstance(text, str) else ""
        if self._plain(text):
            try:
                return self.ranked.encode_ordinary(text)
            except BaseException as error:  # the encoder's panics are no Exceptions
                if type(error).__name__ != "PanicException":
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text) -> np.ndarray:
        """Null counts as empty."""
        return np.frombuffer(array("I", self._ids(text)), np.uint32)

    def count(self, text) -> int:
        """len(encode(text))."""
        return len(self._ids(text))


_made: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for a tokenizer file."""
    path = path or default_path()
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
