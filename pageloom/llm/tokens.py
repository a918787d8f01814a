"""Token ids of whole texts through a bounded cache of text chunks.

A space between two non-space characters is always a boundary of the splitting pattern, so texts are cut there and
each distinct chunk is encoded once. Texts with other runs of white space are cut by the pattern itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import regex

from pageloom.llm.common import worker_state

# White space other than space and newline, and the mark that `chunks` cuts at.
RARE = re.compile("[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def has_runs(text: str) -> bool:
    """Whether white space other than single spaces and newlines inside the text may occur."""
    return bool(RARE.search(text)) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n"


class TokenCache:
    """Encodes texts as bytes of little-endian unsigned 32-bit ids.

    `encode_new` maps a list of chunks to a list of such bytes. Chunks are kept in two generations of at most `most`:
    a full one takes the place of the older one, and what is used again moves on. Chunks of over 64 characters are
    not kept.
    """

    def __init__(self, pattern: str, encode_new: Callable[[list[str]], list[bytes]], most: int = 300_000):
        self.pattern, self.encode_new, self.most = regex.compile(pattern), encode_new, most
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        return self.pattern.findall(text) if has_runs(text) else text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [self.chunks(t or "") for t in texts]
        every = set(chain.from_iterable(cut))
        new = every.difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.older, self.seen = self.seen, {}
            new = every
        again = [c for c in new if c in self.older]
        self.seen.update(zip(again, map(self.older.__getitem__, again), strict=True))
        listed = list(new.difference(again))
        self.seen.update(zip(listed, self.encode_new(listed), strict=True))
        for c in cut:
            yield b"".join(map(self.seen.__getitem__, c))
        for c in listed:
            if len(c) > 64:
                del self.seen[c]


def byte_alphabet() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_ranks(model: str) -> dict[bytes, int] | None:
    """Ids of a byte-level BPE model file as merge ranks, if merging by rank gives what its merge list gives.

    That is so if the ids of the merged tokens rise along the list and every token is what its own bytes merge to.
    """
    from pageloom.llm.bpe import SegmentTreeBpe

    parsed = json.loads(model)
    bpe, special = parsed["model"], {t["content"] for t in parsed.get("added_tokens", [])}
    merged = [m if isinstance(m, str) else " ".join(m) for m in bpe["merges"]]
    order = [bpe["vocab"].get(m.replace(" ", ""), -1) for m in merged]
    alphabet = byte_alphabet()
    if parsed["pre_tokenizer"]["type"] != "ByteLevel" or parsed["pre_tokenizer"]["add_prefix_space"] or parsed["normalizer"]:
        return None
    if bpe["ignore_merges"] or -1 in order or any(a >= b for a, b in zip(order, order[1:], strict=False)):
        return None
    ranks = {bytes(alphabet[c] for c in t): k for t, k in bpe["vocab"].items() if t not in special}
    lines = b"\n".join(base64.b64encode(t) + b" %d" % k for t, k in ranks.items())
    tokens = list(ranks)
    alone = SegmentTreeBpe(lines).pieces(tokens, whole_first=False)
    return ranks if all(ranks[t].to_bytes(4, "little") == x for t, x in zip(tokens, alone, strict=True)) else None


class RankEncoder:
    """Whole texts by rank. Texts without runs of white space need no look-ahead in the pattern, which is its slow part."""

    LOOKAHEAD = r"\s+(?!\S)|"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.full = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(self.LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            yield array("I", (self.full if has_runs(text or "") else self.plain).encode_ordinary(text or "")).tobytes()


class LibraryEncoder:
    """Whole texts through the `tokenizers` library; strings of special tokens in a text are ordinary text."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False):
            yield array("I", found.ids).tobytes()


class ModelFile:
    """A byte-level BPE model file, read on the driver; `encoder()` is what a Python worker keeps.

    Texts are encoded by rank if `byte_ranks` proves that to be the same, else by the `tokenizers` library, which is
    some five times slower.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.model = f.read()
        self.pattern, self.ranks = pattern, byte_ranks(self.model)

    def encoder(self) -> RankEncoder | LibraryEncoder:
        build = (lambda: RankEncoder(self.ranks, self.pattern)) if self.ranks else (lambda: LibraryEncoder(self.model))
        return worker_state("tokens", (hash(self.model), self.pattern), build)
