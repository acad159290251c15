"""Patterns that have to be understood alike by Spark and by the SQL of the tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions.columns import let


#: Letters besides the ASCII ones that a pattern without case takes for ASCII letters, and those.
ODD, ODD_TO = "\u0130\u0131\u017f\u212a", "iisk"
#: Among a pattern's needs: a digit.
DIGIT = object()


def plain(text: Column, lower: Column | None = None) -> Column:
    """The text in lower case, with every letter that a pattern takes for an ASCII one as that. lower: lower() of the text, where it
    is there already."""
    odd = (F.octet_length(text) > F.length(text)) & reduce(or_, [text.contains(x) for x in ODD])
    return F.when(odd, F.lower(F.translate(text, ODD, ODD_TO))).otherwise(F.lower(text) if lower is None else lower)


class Pattern:
    """A regular expression whose \\b, \\w, \\d and \\s know all letters in Spark.

    needs: what every match holds, in plain() letters: ASCII strings, tuples of which one is there, DIGIT. Texts without them are not
    gone through by the expression. start: the expression begins with ^ as a whole and matches no empty text, so that only the
    text's start is looked at. Neither changes what is found."""

    def __init__(self, text: str, flags: str = "i", needs: tuple = (), start: bool = False):
        self.text, self.flags, self.needs, self.start = text, flags, needs, start

    @property
    def java(self) -> str:
        # d: only \n ends a line, as everywhere else
        return f"(?{self.flags}Ud){self.text}"

    @property
    def sql(self) -> str:
        flags = self.flags.replace("u", "")
        return (f"(?{flags})" if flags else "") + self.text

    @property
    def _at_start(self) -> str:
        """What matches every text at its first position, with nothing where the pattern doesn't match."""
        return f"(?{self.flags}Ud)^(?:{self.text[1:]})?"

    def may(self, low: Column) -> Column:
        """Whether a text of which `low` is plain() holds what the pattern needs."""
        out = None
        for need in self.needs:
            one = low.rlike(r"\p{Nd}") if need is DIGIT else reduce(or_, [low.contains(x) for x in ((need,) if isinstance(need, str) else need)])
            out = one if out is None else out & one
        return out

    def found(self, text: Column, low: Column | None = None) -> Column:
        """low: plain() of the text, where it is there already."""
        if self.start:
            return F.regexp_extract(text, self._at_start, 0) != ""
        here = text.rlike(self.java)
        return self.may(plain(text) if low is None else low) & here if self.needs else here

    def first(self, text: Column, group: int = 1, low: Column | None = None) -> Column:
        """Null where there is none."""
        one = F.regexp_extract(text, self._at_start if self.start else self.java, group)
        return F.nullif(F.when(self.may(plain(text) if low is None else low), one) if self.needs else one, F.lit(""))

    def every(self, text: Column, group: int = 1, low: Column | None = None) -> Column:
        all_ = F.regexp_extract_all(text, F.lit(self.java), F.lit(group))
        return F.when(~self.may(plain(text) if low is None else low), F.array().cast("array<string>")).otherwise(all_) if self.needs else all_

    def replaced(self, text: Column, by: str) -> Column:
        return F.regexp_replace(text, self.java, by)


def any_of(patterns, text: Column) -> Column:
    def of(low: Column | None) -> Column:
        return reduce(or_, [p.found(text, low) for p in patterns], F.lit(False))

    return let(plain(text), of) if any(p.needs for p in patterns) else of(None)


def quoted(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], *columns: str) -> str:
    """Rows as a SQL relation."""
    one = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS fixture({', '.join(columns)})"
