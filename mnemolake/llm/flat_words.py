"""Words of many texts as flat arrays: where they are, which are equal, a hash of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from mnemolake.llm.common import SPACES, utf8

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def words(at: np.ndarray, raw: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last + 1, text) of each word of texts laid end to end. between: of each byte,
    whether it stands between words."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~between[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # a word ends where its text ends
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    first = np.nonzero(solid & ~before)[0]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    last = np.nonzero(solid & ~after)[0] + 1
    text = np.searchsorted(at, first, "right") - 1
    return first, last, text


def coded(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words): equal codes are equal words, compared byte
    by byte. The words must be all that raw holds but white space."""
    if not len(first):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    solid = raw[~_SPACE[raw]]
    ends = np.concatenate([[0], np.cumsum(last - first)])
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
    return told.indices.to_numpy().astype(np.int64), told.dictionary


def hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of each word, taken once for each distinct one."""
    code, distinct = coded(raw, first, last)
    at, flat = utf8(distinct)
    data = flat.tobytes()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], 7) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)[code]


def window_groups(code: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, group) of each run of width words within one text; groups are equal
    where text and words are, exactly."""
    n = len(code) - width + 1
    at = np.nonzero(text[:n] == text[width - 1 :])[0] if n > 0 else np.zeros(0, np.int64)
    group = text[at]
    for k in range(width):
        span = int(code.max()) + 1 if len(code) else 1
        if int(group.max(initial=0)) >= (1 << 62) // span:  # renumbered where the product would not fit
            group = np.unique(group, return_inverse=True)[1]
        group = group * span + code[at + k]
    return at, np.unique(group, return_inverse=True)[1] if len(at) else group
