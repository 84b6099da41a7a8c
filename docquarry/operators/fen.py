"""Class grids to board strings, in builtins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class number to board character, empty for an empty square.
CLASSES = {"Black_Bishop": "b", "Black_King": "k", "Black_Knight": "n", "Black_Pawn": "p", "Black_Queen": "q", "Black_Rook": "r", "Empty_Square": "", "White_Bishop": "B", "White_King": "K", "White_Knight": "N", "White_Pawn": "P", "White_Queen": "Q", "White_Rook": "R"}
CHARS = list(CLASSES.values())


def argmax(values: Column) -> Column:
    """Place (from 0) of the greatest value, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def class_char(number: Column) -> Column:
    """Board character of a class; unknown classes count as empty."""
    return F.coalesce(F.get(F.array(*map(F.lit, CHARS)), number.cast("int")), F.lit(""))


def encode(chars: Column) -> Column:
    """Eight rows of eight characters ("" for empty), as one array of 64, to the board part of FEN."""

    def row(i):
        cells = F.transform(F.slice(chars, i * 8 + 1, 8), lambda c: F.when(c == "", "1").otherwise(c))
        return reduce(lambda t, n: F.replace(t, F.lit("1" * n), F.lit(str(n))), range(8, 1, -1), F.array_join(cells, ""))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), row), "/")


def encode_full(chars: Column) -> Column:
    """With white to move and no castling or counters kept."""
    return F.concat(encode(chars), F.lit(" w - - 0 1"))
