"""Piece tables of SentencePiece models, and the cuts between pre-tokens that no piece crosses."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

SPACE = "▁"
#: Known tables have 10^4 to 10^6 pieces; what goes to every task is checked against this.
MAX_PIECES = 2_000_000
#: Scores are multiples of one over this, so that sums are exact and ties do not depend on the order of addition.
STEPS = 4096
#: A run of spaces with the word behind it, or a line break by itself.
PRE_TOKEN = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


@dataclass(frozen=True)
class PieceTable:
    """Scores and ids of the pieces; ids of the byte pieces; score of a character that is no piece."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    unknown_score: float
    unknown_id: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load_pieces(model_file: str) -> PieceTable:
    """The table of a SentencePiece model file (read on the driver; the path is the user's).

    A unigram model has log probabilities, which are taken to the next step. A merge model has ranks instead; rank r becomes
    ln(1 / ((r + 1) H)), H the sum of 1 / (r + 1): a word list in order of use with Zipf's frequencies, in steps of 1/256. Nothing is trained. Control
    pieces are left out, byte pieces spell characters that are no piece, at ten below the smallest score.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{size} pieces; at most {MAX_PIECES} go to every task")
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in plain}
    if scores and min(scores.values()) < -1000 or any(s > 0 for s in scores.values()):
        order = sorted(plain, key=lambda i: (-scores[i], i))
        total = sum(1 / (r + 1) for r in range(len(order)))
        scores = {i: round(-256 * math.log((r + 1) * total)) / 256 for r, i in enumerate(order)}
    pieces = {model.id_to_piece(i): (i, round(scores[i] * STEPS) / STEPS) for i in plain}
    crossing = [p for p in pieces if not PRE_TOKEN.fullmatch(p)]
    if crossing:
        raise ValueError(f"pieces cross the cuts between pre-tokens: {crossing[:5]}")
    spelled = sorted((model.id_to_piece(i), i) for i in range(size) if model.is_byte(i))
    if len(spelled) != 256:
        raise ValueError("the table needs the 256 byte pieces")
    return PieceTable(pieces, [i for _, i in spelled], min(s for _, s in pieces.values()) - 10, model.unk_id())


def pre_tokens(text: str | None) -> list[str]:
    """The text with a space in front and spaces as U+2581, cut where no piece can cross; none for null or empty."""
    return PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []
