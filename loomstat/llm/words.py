"""Words of texts as numbers, by Arrow's vectorised functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words, words of each text, and the distinct words in UTF-8."""
    # ASCII split keeps an empty piece at a text's ends; those are dropped below.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:
        empty = words.index(b"")
        keep = numbers != empty
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[keep], minlength=len(lengths))
        numbers = numbers[keep]
        numbers -= numbers > empty
        del words[empty]
    return numbers, lengths, words


def gathered(parts: list[bytes], numbers: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """For each text the joined ``parts`` of its words; as ``tokenise`` returns them."""
    taken = pa.array(parts, pa.large_binary()).take(pa.array(numbers))
    if not len(taken):
        return [b""] * len(lengths)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    stops = offsets[np.cumsum(lengths)].tolist()
    data = memoryview(taken.buffers()[2])
    return [bytes(data[a:b]) for a, b in zip([int(offsets[0]), *stops], stops, strict=False)]
