"""What the SentencePiece operators share: the pieces of a model file, and units of text.

A unit is a run of spaces with the run of other bytes behind it. Pieces hold
spaces at their start only, so no piece crosses units; bytes that occur in no
piece (such as a line feed) are units of their own. Both are read off the model,
and a model of another build is refused. Texts are taken as the library takes
them: unchanged but for a space put before a text that isn't empty, and U+2581
meaning a space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .vectext import PLAIN, span_hashes

SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    """Normal pieces with their scores and ids, spaces written as spaces, and the ids of the 256 bytes."""

    text: list[str]
    score: list[float]
    ids: list[int]
    byte_ids: list[int]
    alone: np.ndarray  # bytes that occur in no piece

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a model file of the sentencepiece library; the path is the caller's parameter."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        ids = [i for i in range(model.vocab_size()) if not special(i)]
        text = [model.id_to_piece(i).replace(SPACE, " ") for i in ids]
        if any(" " in t.lstrip(" ") for t in text) or model.encode("a  b\n") != model.encode("a  b\n", add_bos=False) or model.encode("", out_type=str) or not model.encode(" a", out_type=str)[0].startswith(SPACE):
            raise ValueError("a model whose pieces hold spaces at their start only, with a dummy prefix, is needed")
        alone = np.ones(256, dtype=bool)
        for t in text:
            alone[np.frombuffer(t.encode(), np.uint8)] = False
        alone[128:] = False
        return Pieces(text, [model.get_score(i) for i in ids], ids, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], alone)


def prefixed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each that isn't empty, and U+2581 as a space."""
    data = raw.tobytes()
    rows = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    if SPACE.encode() in data:
        rows = [r.replace(SPACE.encode(), b" ") for r in rows]
    rows = [b" " + r if r else r for r in rows]
    out = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=out[1:])
    return np.frombuffer(b"".join(rows), dtype=np.uint8), out


def units(raw: np.ndarray, at: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all units, and for each row where its units begin."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros(len(at), np.int64)
    space, own = raw == 32, alone[raw]
    first = own.copy()
    first[1:] |= own[:-1] | (space[1:] & ~space[:-1])
    first[at[at < len(raw)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(raw))
    return starts, ends, span_hashes(raw, starts, ends, PLAIN), np.searchsorted(starts, at)
