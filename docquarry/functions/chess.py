"""Chess notation in OCR text: cleaning, tokens and the game-notation signal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CASTLING = [("0-0-0", "O-O-O"), ("0-0", "O-O"), ("o-o-o", "O-O-O"), ("o-o", "O-O")]
OCR_LITERALS = [*CASTLING, ("§", "5"), ("|", "1"), ("l", "1"), ("—", "-"), ("–", "-")]
FIGURINES = "♔♚♕♛♖♜♗♝♘♞♙♟"
FIGURINE_LETTERS = "KKQQRRBBNN"
NOISE = ["attacking", "attack", "defence", "defending", "check", "from", "the", "and", "wins", "capture", "square", "mate", "threat", "idea", "with", "after", "white", "black"]
TOKEN = r"(O-O-O|O-O|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?|\d+\.(?:\.\.)?)"
MOVE_NUMBER = r"^\d+\.(?:\.\.)?$"


def _literals(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _patterns(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, *p), pairs, text)


def normalize_ocr(text: Column) -> Column:
    """Literal repairs in their order: castling, look-alike digits, dashes."""
    return _literals(text, OCR_LITERALS)


def normalize_chess(text: Column) -> Column:
    """Castling, multiplication signs, dashes and figurines as plain notation; white space collapsed."""
    plain = F.translate(_literals(text, CASTLING), "×–—♔♕♖♗♘♚♛♜♝♞", "x--KQRBNKQRBN")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def replace_figurines(text: Column) -> Column:
    return F.translate(text, FIGURINES, FIGURINE_LETTERS)


def fix_confusions(text: Column) -> Column:
    """An 8 that stands for a bishop, and castling with zeros."""
    return _patterns(text, [(r"\b8(?=[a-hx])", "B"), (r"\b8([a-h][1-8])", "B$1"), (r"(?<=\s)8(?=[a-h])", "B"), (r"\b0-0-0\b", "O-O-O"), (r"\b0-0\b", "O-O")])


def collapse_squares(text: Column) -> Column:
    return _patterns(text, [(r"([a-h][1-8])[1-8]+", "$1"), (r"([KQRBN]?[a-h]?x?[a-h][1-8])[1-8]+", "$1")])


def keep_notation(text: Column) -> Column:
    kept = F.regexp_replace(replace_figurines(text), r"[^KQRBNa-hxO0-9.\-+#=:/ ]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_move_numbers(text: Column) -> Column:
    return _patterns(text, [(r"(\d+)\.([KQRBNa-hO])", "$1. $2"), (r"(\d+)\.\.\.([KQRBNa-hO])", "$1... $2"), (r"(^|\s)\.\.([KQRBNa-hO])", "$1$2")])


def split_moves(text: Column) -> Column:
    return _patterns(text, [(r"([a-h1-8])([KQRBN])", "$1 $2"), (r"([+#])([KQRBNa-hO])", "$1 $2")])


def remove_noise(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"(?iU)\b(?:{'|'.join(NOISE)})\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def notation_line(text: Column) -> Column:
    """A cleaned line of notation, or null if under four characters or without a square.

    Noise words need no step of their own: of the letters that are kept only "defeNce", "checK"
    and "aNd" could be written, and their capitals have been split off."""
    steps = (normalize_ocr, fix_confusions, collapse_squares, keep_notation, normalize_move_numbers, split_moves)
    line = F.trim(F.regexp_replace(reduce(lambda t, f: f(t), steps, text), r"\s+", " "))
    return F.when((F.length(line) >= 4) & line.rlike("[a-h][1-8]"), line)


def tokens(text: Column) -> Column:
    """Moves and move numbers in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def is_move_number(token: Column) -> Column:
    return token.rlike(MOVE_NUMBER)


def opens_a_game(token: Column) -> Column:
    """Whether a token can be played from the start position: 16 pawn moves and 4 knight moves."""
    pawn = token.rlike(r"^2?x?[a-h][34][+#]?$") | token.rlike(r"^([a-h])2?x?\1[34][+#]?$")
    return pawn | token.rlike(r"^N(?:b?1?x?[ac]3|g?1?x?[fh]3)[+#]?$")


def notation_signal(text: Column) -> Column:
    """Struct: numbers, moves, valid, signal, flag and score of OCR text."""
    found = tokens(normalize_chess(F.coalesce(text, F.lit(""))))
    numbers = F.size(F.filter(found, is_move_number))
    moves = F.size(found) - numbers
    valid = F.size(F.filter(found, lambda t: ~is_move_number(t) & opens_a_game(t)))
    signal = F.round(numbers + 1.2 * moves + 1.5 * valid, 6)
    flag = ((numbers >= 3) & (moves >= 8)) | (signal >= 18)
    score = F.when(flag, F.round(F.least(F.lit(1.0), signal / 30.0), 4)).otherwise(0.0)
    return F.struct(numbers.alias("numbers"), moves.alias("moves"), valid.alias("valid"), signal.alias("signal"), flag.cast("int").alias("flag"), score.alias("score"))
