"""Token ids of a byte-level BPE vocabulary file, as numpy arrays."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

VOCABULARY = "byte_bpe_50k.json"
LONG_SPACE = 256  # the cost of the pattern grows with the square of a run, and it gives up on one of a million
_SPACE_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself where printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a ``tokenizers`` file in the faster library; ids are the same (tested), and so is the split at the file's added tokens.

    Ids rise with the merges, so an id is its rank.
    """
    import public_tokenizers
    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    added = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in stored["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids_of(text: str, path: str) -> np.ndarray:
    """Token ids of a text. Long runs of white space are merged without the pattern, cut where it cuts them.

    The pattern leaves a run's last character to a visible one that follows, but not at the end or before an added token.
    """
    found, parts, at = encoding(path), [], 0
    added = tuple(found.special_tokens_set)
    for run in _SPACE_RUN.finditer(text):
        whole = run.end() == len(text) or text.startswith(added, run.end())
        stop = run.end() if whole else run.end() - 1
        parts += [found.encode_to_numpy(text[at:run.start()], allowed_special="all"),
                  np.array(found._encode_single_piece(text[run.start():stop]), np.uint32)]
        at = stop
    rest = found.encode_to_numpy(text[at:], allowed_special="all")
    return np.concatenate([*parts, rest]) if parts else rest
