"""Byte-level BPE encoding and decoding, long unsplit text by tree concatenation.

The vocabulary and merges come from a tokenizer file whose path is a parameter. A text is split at special tokens, then by the
pattern of the file's pre-tokenizer, and each piece is merged by rank. Every piece over LEAF bytes, of letters, white space or anything else, is
halved (between characters) down to leaves, which threads of the task encode in parallel (the encoder lets go of the interpreter for them),
and halves are joined upwards: a window of tokens around the join is encoded anew and grows until its first token is the left half's and its last the right half's own. Adjacent tokens of an encoding re-encode to themselves, and a sequence all of
whose adjacent pairs do so is the encoding of its bytes; the join keeps that, so the result is exactly that of encoding the whole.

Encoding uses the merges through tiktoken's ranks, which are the ids, as long as these follow the file's order of merges (else it is an error); texts with characters on which
the two libraries' tables of Unicode classes may differ (unassigned to one of them) are split by the tokenizers library itself. Decoding
joins the bytes of tokens and replaces what isn't UTF-8. A tokenizer file of another kind than byte-level BPE with this pattern is an error.

Defined results: a null text is empty and has no tokens; repeated rows are encoded alike; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_text

LEAF = 2048
THREADS = 4  # of a task, for the leaves of a long piece
#: The pre-tokenizer's pattern of byte-level vocabularies of this kind. Fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that vocabulary files have for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space as the pattern has it. Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run that may be a piece over LEAF bytes: a character has 4 bytes at most, and a blank may come before.
RUN = re.compile(rf"[^{SPACE}]{{{LEAF // 4 - 1},}}|[{SPACE}]{{{LEAF // 4 - 1},}}")


SYMBOLS = {ord(c): b for c, b in _byte_symbols().items()}


@dataclass
class Bpe:
    """A vocabulary: ranks of byte strings, special tokens, and each id's bytes."""

    ranks: dict[bytes, int]
    special: dict[str, int]
    pieces: list[bytes]
    path: str

    def __post_init__(self) -> None:
        import tiktoken

        self.core = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        # Takes any text for one piece.
        self.unsplit = tiktoken.Encoding("leaves", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.plain = regex.compile(r"[\x00-˿Ͱ-ͳ΄-ϿЀ-ԯ‐-‧‰-⁞₠-₿]*")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    @functools.cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(THREADS)

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece's bytes, by tree concatenation where it is long."""
        if len(data) <= LEAF:
            return self.whole(data)
        cuts = [0, len(data)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > LEAF:  # halves, their halves, and so on: the leaves of one level
            cuts = sorted({*cuts, *(self.between(data, (a + b) // 2) for a, b in zip(cuts, cuts[1:], strict=False))})
        level = list(self.pool.map(self.unsplit.encode_ordinary, (data[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False))))
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = joined + level[2 * len(joined) :]
        return level[0]

    @staticmethod
    def between(data: bytes, at: int) -> int:
        """The place at or before `at` where a character begins."""
        while data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of what two token lists encode, by re-encoding a growing window around the join."""
        size = 4
        while True:
            a, b = left[max(0, len(left) - size) :], right[:size]
            middle = self.whole(b"".join(map(self.pieces.__getitem__, a + b)))
            left_ok = len(a) == len(left) or middle[0] == a[0]
            right_ok = len(b) == len(right) or middle[-1] == b[-1]
            if left_ok and right_ok:
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            size *= 2

    def whole(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data)

    def ordinary(self, text: str) -> list[int]:
        """The tokens of a text without special tokens."""
        plain = self.plain.fullmatch(text)
        if not RUN.search(text):
            return self.core.encode_ordinary(text) if plain else self.library.encode(text, add_special_tokens=False).ids
        if plain:
            pieces = (p.encode() for p in self.pattern.findall(text))
        else:
            pieces = (p.translate(SYMBOLS).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        return [i for p in pieces for i in self.piece(p)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        out: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _checked(j: dict) -> None:
    """Raises for a tokenizer file that says anything which this module takes for granted otherwise."""
    pre, model = j.get("pre_tokenizer") or {}, j["model"]
    wrong = [
        name
        for name, ok in {
            "model": model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback"),
            "merges": all(model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) >= 0 for m in model["merges"]),
            # Ranks are ids, so ids must be in the order of merges.
            "order of merges": all(a < b for a, b in itertools.pairwise(model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"])),
            "normalizer": not j.get("normalizer"),
            "pre_tokenizer": pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True),
            "decoder": (j.get("decoder") or {}).get("type") == "ByteLevel",
            "added_tokens": not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in j["added_tokens"]),
        }.items()
        if not ok
    ]
    if wrong:
        raise ValueError(f"not a byte-level BPE vocabulary of the kind that is read here: {', '.join(wrong)}")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary of a tokenizer file, once for each worker."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    _checked(j)
    symbols = _byte_symbols()
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): i for token, i in j["model"]["vocab"].items() if token not in special}
    pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    for token, i in special.items():
        pieces[i] = token.encode()
    return Bpe(ranks, special, pieces, path)


def encode_texts(docs: DataFrame, path: str, *, keep: list[Column], schema: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256 and decoded_sha256 of each whole text, and the ids if asked for."""

    def run(texts: list) -> dict[str, pa.Array]:
        bpe = load(path)
        n, ids_sha, text_sha, listed = [], [], [], []
        for t in texts:
            ids = bpe.encode(t)
            data = np.array(ids, "<u4")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(data.tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            if with_ids:
                listed.append(data.astype(np.int32))
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        return out | {"ids": pa.array(listed, pa.list_(pa.int32()))} if with_ids else out

    return map_text(docs, keep, F.col(text_col), run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
