"""Token ids of a public byte-level BPE vocabulary, given as a tokenizers JSON file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: The split pattern of the byte-level BPE family (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class all regex engines agree. Any other goes the slow way, through tokenizers itself.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-Ƞɐ-ʯΑ-ΡΣ-ώА-я]*")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow
    from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids equal to tokenizers' encode(text, add_special_tokens=False). The merge loop is tiktoken's, over the ranks of the same
    JSON file, about eight times as fast here; a text that holds an added token's content, or characters outside a plain set,
    goes through tokenizers, so that neither added tokens nor any engine's Unicode tables matter."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _tokenizer(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def ids(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not self.added.search(text):
            return self.fast.encode_ordinary(text)
        return self._tokenizer().encode(text, add_special_tokens=False).ids


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
