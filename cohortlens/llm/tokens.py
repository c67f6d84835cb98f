"""Token ids of whole texts by a public byte-level BPE, fast where a word was seen before."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from . import texts as shared

JSON_PATH = public_tokenizers.path("byte_bpe_50k.json")  # both must be readable on every executor
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SLICE_BYTES = 4 * 1024 * 1024  # text encoded in one go
CACHE_PIECES = 100_000  # pieces a task remembers the ids of; beyond it the memory starts anew

# The tokenizer never joins what a single space or line feed parts, so texts with no other white space are looked up in
# pieces cut there.  Runs of white space, other kinds of it, and NUL (the mark of a cut) send the whole text to the tokenizer.
_WHOLE = r"[ \n][ \n]|[\x00\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Ids of texts as ``tokenizers`` gives them with ``add_special_tokens=False``."""

    def __init__(self, json_path: str = JSON_PATH, ranks_path: str = RANKS_PATH):
        self._json_path, self._loaded = json_path, None
        with open(json_path, encoding="utf-8") as file:
            self._special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}
        self._line_feed = int(self._ranks.encode_single_token("\n"))

    @property
    def _whole(self) -> Tokenizer:
        """The tokenizer itself, loaded when the first text needs it: workers share little memory."""
        if self._loaded is None:
            self._loaded = Tokenizer.from_file(self._json_path)
        return self._loaded

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text in order, as unsigned 32-bit integers; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 64)
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
            yield from self._slice(texts.slice(at, until - at))
            at = until

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, _WHOLE)
        special = pa.array([False] * len(texts))
        for content in self._special:  # control strings have ids of their own
            special = pc.or_(special, pc.match_substring(texts, content))
        pieced = self._pieced(texts.filter(pc.invert(pc.or_(whole, special))))
        for i, (alone, control) in enumerate(zip(whole.to_pylist(), special.to_pylist())):
            if control:
                yield np.array(self._whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            elif alone:
                yield self._ranks.encode_to_numpy(texts[i].as_py(), disallowed_special=()).astype("<u4")
            else:
                yield next(pieced)

    def _pieced(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts whose pieces are looked up: every distinct piece once, the rest by numpy."""
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        self._learn(distinct)
        known = [self._known[p] for p in distinct]
        widths = np.fromiter(map(len, known), np.int32, len(known)) // 4  # a slice has fewer ids than bytes, below 2**31
        stored = np.frombuffer(b"".join(known), "<u4")
        index = pieces.indices.to_numpy(zero_copy_only=False)
        width = widths[index]
        ends = np.concatenate(([0], np.cumsum(width)))
        place = np.repeat(((np.cumsum(widths) - widths)[index] - ends[:-1]).astype(np.int32), width)
        place += np.arange(len(place), dtype=np.int32)
        ids = stored[place]
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        for start, end in zip(bounds[:-1], bounds[1:]):
            yield ids[start:end]

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces, found by one call over all of them, a line each."""
        if len(self._known) > CACHE_PIECES:
            self._known.clear()
        if not self._known:
            self._known |= {"": b"", "\n": np.array([self._line_feed], "<u4").tobytes()}
        new = [p for p in pieces if p not in self._known]
        if not new:
            return
        ids = self._ranks.encode_to_numpy("\n".join(new), disallowed_special=()).astype("<u4")
        cuts = np.flatnonzero(ids == self._line_feed)
        blob = ids.tobytes()
        starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(blob)]
        self._known.update(zip(new, (blob[a:b] for a, b in zip(starts, ends)), strict=True))


def encoder(json_path: str = JSON_PATH, ranks_path: str = RANKS_PATH) -> Encoder:
    """The encoder of this process."""
    encoders = shared.remembered("tokens")
    if (json_path, ranks_path) not in encoders:
        encoders[json_path, ranks_path] = Encoder(json_path, ranks_path)
        shared.give_back()
    return encoders[json_path, ranks_path]
