"""A fixed public piece vocabulary: pieces, scores and byte pieces, and cuts that no piece crosses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

SPACE = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: what an uncovered character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: list[str]  # by id; "" for control, unknown and byte pieces
    scores: list[float]
    byte_ids: list[int]  # by byte value; empty without byte fallback
    ids: dict[str, int] = field(init=False, repr=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {}
        for i, p in enumerate(self.pieces):
            if p:
                self.ids.setdefault(p, i)
        self.longest = max(map(len, self.ids), default=1)

    @cached_property
    def unknown_score(self) -> float:
        return min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def trie(self) -> dict:
        """Nested dicts by character; the piece's id under the empty string."""
        root: dict = {}
        for p, i in self.ids.items():
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        return root

    @cached_property
    def cut_pattern(self) -> str:
        """A regular expression whose matches tile a text (spaces still plain) so that no piece crosses from one to the next.

        Words take their leading spaces. Where the vocabulary has a piece with a space after another
        character, the text stays whole. Characters of no piece stand alone.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return r"(?s:.+)"
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        return rf" *[^ {lone}]+| +" + (f"|{lone}" if lone else "")

    @classmethod
    def load(cls, path: str = PIECES) -> Vocabulary:
        """Read a model file with the public library; only its table of pieces is used."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        at = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else []
        return cls([m.id_to_piece(i) if plain[i] else "" for i in range(n)], [m.get_score(i) for i in range(n)], byte_ids)

    def cuts(self, text: str) -> list[str]:
        return re.findall(self.cut_pattern, text)
