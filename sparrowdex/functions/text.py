"""Text analysis as column expressions, and the same on the driver for query strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators between tokens: everything but letters and digits.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: A short English stopword list; analyzers take any other.
STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


@dataclass(frozen=True)
class Analyzer:
    """Lower-cases, splits, drops stopwords (which keep their positions), and may take plural endings off.

    ``stem`` is a small rule-based one for English plurals, so that the same rules can be stated in SQL.
    """

    stopwords: frozenset = frozenset()
    stem: bool = False

    def tokens(self, text: Column) -> Column:
        """All tokens in order, stopwords included; an empty array for null."""
        parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")
        return F.transform(parts, self._stemmed) if self.stem else parts

    @staticmethod
    def _stemmed(t: Column) -> Column:
        return F.when(F.length(t) <= 3, t).when(t.endswith("ies"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("[^us]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)

    def is_indexed(self, term: Column) -> Column:
        return ~term.isin(*sorted(self.stopwords)) if self.stopwords else F.lit(True)

    def terms(self, text: str) -> list[str]:
        """Indexed terms of a string on the driver."""
        found = [t for t in re.split(r"[\W_]+", text.lower()) if t]
        if self.stem:
            found = [t if len(t) <= 3 else re.sub("ies$", "y", t) if t.endswith("ies") else re.sub("s$", "", t) if re.search("[^us]s$", t) else t for t in found]
        return [t for t in found if t not in self.stopwords]


#: White space as answers know it, Unicode's included; letters and digits, of which words consist.
BLANK, WORDLIKE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]", r"[\p{L}\p{N}]"
#: Ends of lines of a reply.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"
#: Labels before a short answer: fixed values.
LABELS = ("answer:", "short answer:", "final answer:", "exact answer:")


def normalized_answer(text: Column) -> Column:
    """Lower case, underscores and ASCII punctuation as spaces, no articles that stand alone, single spaces."""
    plain = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "_", " ")), r"[!-/:-@\[-`{-~‘’´]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"(?<!{WORDLIKE})(a|an|the)(?!{WORDLIKE})", " "), f"{BLANK}+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def cleaned_reply(text: Column) -> Column:
    """The first line of a model's reply that isn't empty, without an answer label and one pair of quotes.

    A line that is only a label gives way to the next one. Replies that report an exception are kept, but for blanks around them.
    """
    text = stripped(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), stripped), lambda x: x != "")
    line = F.when((F.size(lines) > 1) & F.lower(F.get(lines, F.lit(0))).isin(*LABELS), F.get(lines, F.lit(1))).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    line = F.regexp_replace(line, f"(?i)^({'|'.join(LABELS)}){BLANK}*", "")
    quoted = (F.length(line) >= 2) & F.left(line, F.lit(1)).isin("'", '"') & (F.left(line, F.lit(1)) == F.right(line, F.lit(1)))
    return F.when(text.startswith("EXCEPTION::"), text).when(quoted, stripped(F.substr(line, F.lit(2), F.length(line) - 2))).otherwise(line)
