"""Where the public tokenizers' files are; operators take the path as a parameter."""

from __future__ import annotations

import public_tokenizers


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
