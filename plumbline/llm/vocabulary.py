"""The rules by which one public tokenizer file cuts a text, shared by the token operators.

White space always ends a piece and is never part of one, for every tokenizer
file whose pre-tokenizer drops it.  So a text can be cut at ASCII white space
first, and each distinct chunk has to be looked at once.
"""

from __future__ import annotations

import json

#: Fixed value: the pre-token pattern for which the above holds.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_FILE = "word_bpe_49k.json"


def vocabulary_path(name: str = WORD_FILE) -> str:
    """Where the tokenizer file lies; read on the executors, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def drops_space(path: str) -> bool:
    """Whether texts may be cut in that way for this file."""
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    return pattern == CUTS and first.get("behavior") == "Removed" and bool(first.get("invert"))
