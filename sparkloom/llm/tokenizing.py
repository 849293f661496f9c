"""Byte-level BPE ids inside Python workers; the vocabulary path is a parameter."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import public_tokenizers

#: The tokenizer whose ids count; RANKS holds the same vocabulary as merge ranks.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids equal to ``Tokenizer.from_file(vocabulary)`` with add_special_tokens=False.

    The merge-rank form of the same vocabulary encodes about four times
    faster on one core, so it goes first; where it declines a text (for
    example a run of spaces beyond its regex engine's limits) the tokenizer
    file itself is used. tests/llm hold the two against each other.

    With special, as in ``encoder``, the text of an added token such as
    ``<|endoftext|>`` gives its one id, as the tokenizer file has it as
    loaded; texts that hold one go to the file. Without, such text is
    encoded like any other (``encode_special_tokens``).
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, special: bool = False):
        self._vocabulary, self._special, self._slow, self._fast = vocabulary, special, None, None
        self._added: list[str] = []
        if special:
            with open(vocabulary, encoding="utf-8") as f:
                self._added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self._fast is not None and not any(t in text for t in self._added):
            try:
                return self._fast.encode_ordinary(text)
            except BaseException as e:  # the library raises its own panic type
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._vocabulary)
            self._slow.encode_special_tokens = not self._special
        return self._slow.encode(text, add_special_tokens=False).ids

    def array(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids, then the end id if given."""
        ids = self.encode(text) if text else []
        return np.array(ids if end is None else [*ids, end], dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary, ranks, special=True)
