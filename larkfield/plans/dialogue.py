"""The state of a search conversation on the driver: texts that don't resolve are joined with the next, and open questions are asked a few times at most."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions.text import prefecture

#: Times in a row that a fragment is joined with the next text; questions asked before the best guess is taken; options of a question.
FRAGMENTS, QUESTIONS, OPTIONS = 5, 3, 5


class ClarificationNeeded(Exception):
    """A question for the user: options (label, lat, lng), none for a free answer."""

    def __init__(self, question: str, options: list[tuple[str, float, float]] = ()):
        super().__init__(question)
        self.question, self.options = question, list(options)


@dataclass
class Dialogue:
    pending: str = ""
    tries: int = 0
    asked: int = 0
    log: list[str] = field(default_factory=list)

    def heard(self, text: str) -> str:
        """The text to parse: with the fragments before it."""
        return f"{self.pending}。{text}" if self.pending else text

    def unresolved(self, text: str) -> bool:
        """Keep a text that didn't resolve for the next; False, and all forgotten, after FRAGMENTS in a row."""
        self.tries += 1
        if self.tries >= FRAGMENTS:
            self.resolved()
            return False
        self.pending = self.heard(text)
        return True

    def resolved(self) -> None:
        self.pending, self.tries = "", 0

    def ask(self, question: str, options: list[tuple[str, float, float]] = ()) -> None:
        """Raise the question; after QUESTIONS of them do nothing, so that the caller takes its best guess."""
        if self.asked < QUESTIONS:
            self.asked += 1
            self.log.append(question)
            raise ClarificationNeeded(question, options)


def options(found: DataFrame, most: int = OPTIONS) -> list[tuple[str, float, float]]:
    """(label, lat, lng) of the places that a text may mean: the first of each prefecture (of all without address), `most` of them."""
    area = F.coalesce(prefecture(F.col("address")), F.lit("")) if "address" in found.columns else F.lit("")
    first = found.groupBy(area.alias("area"), *([] if "address" in found.columns else ["id"])).agg(F.min(F.struct("id", "name", "lat", "lng")).alias("r"))
    return [(r["name"], r["lat"], r["lng"]) for r in first.select("r.*").orderBy("id").limit(most).collect()]
