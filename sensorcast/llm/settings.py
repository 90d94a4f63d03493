"""Production parameters of the registered queries."""

from __future__ import annotations

import public_tokenizers

TOKENS_PER_SEQUENCE = 2048
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_PATTERN = public_tokenizers.PATTERN
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096

# Shares of tokens that the mixture should have; sources that are not listed share what is left.
SOURCE_SHARES = {"src0": 0.20} | {f"src{n}": 0.04 for n in range(1, 20)}
LANG_SHARES = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}
TOPIC_SHARES = {"prose": 0.94, "table": 0.05, "noise": 0.01}
KEEP = 0.6
