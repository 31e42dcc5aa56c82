"""What a test run's output says so far, as a tally that chunk after chunk is added to.

A tally is made from whole lines (from whole test cases, in XML) and merges with the tally of what comes
after: a later pytest summary replaces an earlier one, the first "Tests:" line of vitest stands, marks and
cases add up.  Merging is associative, so any cut of a text gives what the whole text gives; what is not
whole yet waits in `line` and `case`.  The counts are those of functions.text.test_counts.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

DIALECTS = ("pytest", "vitest", "gotest", "junit", "auto")
_CASE = re.compile(r"<testcase(?=[\s/>])", re.ASCII)
_CLOSED = re.compile(r"[^>]*/\s*>", re.ASCII)
_ACTION = re.compile(r'"Action":"(pass|fail|skip)"')
_LAST_NUMBER = re.compile(r"([0-9]+)[^0-9]*$")


def count_before(line: str, word: str) -> int | None:
    """The last number that stands before the first `word` of a line."""
    head, met, _ = line.lower().partition(word)
    found = _LAST_NUMBER.search(head) if met else None
    return int(found[1]) if found else None


@dataclass
class Tally:
    pytest: list[int] | None = None
    marks: list[int] = field(default_factory=lambda: [0, 0])
    total: list[int | None] | None = None
    gotest: list[int] = field(default_factory=lambda: [0, 0, 0])
    junit: list[int] = field(default_factory=lambda: [0, 0, 0, 0])

    def then(self, later: Tally) -> Tally:
        """The tally of what this and what comes after it say together."""
        add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
        return Tally(
            self.pytest if later.pytest is None else later.pytest,
            add(self.marks, later.marks),
            later.total if self.total is None else self.total,
            add(self.gotest, later.gotest),
            add(self.junit, later.junit),
        )

    def counts(self, dialect: str) -> tuple[int, int, int, int]:
        """(passed, failed, skipped, inconclusive)."""
        if dialect == "pytest":
            return tuple(self.pytest or (0, 0, 0, 0))
        if dialect == "vitest":
            total = self.total or (None, None, None)
            return (*(m if t is None else t for t, m in zip(total, (*self.marks, 0), strict=True)), 0)
        if dialect == "gotest":
            return (*self.gotest, 0)
        if dialect == "junit":
            return tuple(self.junit)
        if dialect == "auto":
            each = [self.counts(d) for d in DIALECTS[:-1]]
            return (*(max(e[i] for e in each) for i in range(3)), 0)
        raise ValueError(f"unknown dialect: {dialect}")


def of_lines(lines: list[str]) -> Tally:
    out = Tally()
    for x in lines:
        if " in " in x and ("passed" in x or "failed" in x or "error" in x):
            out.pytest = [count_before(x, w) or 0 for w in ("passed", "failed", "skipped", "error")]
        if "✓" in x:
            out.marks[0] += 1
        elif "✗" in x or "×" in x:
            out.marks[1] += 1
        bare = x.strip(" ")
        if out.total is None and bare.startswith("Tests:"):
            out.total = [count_before(x, w) for w in ("passed", "failed", "skipped")]
        for i, (mark, word) in enumerate((("--- PASS: ", "pass"), ("--- FAIL: ", "fail"), ("--- SKIP: ", "skip"))):
            if bare.startswith(mark):
                out.gotest[i] += 1
                break
        else:
            if found := _ACTION.search(x):
                out.gotest[("pass", "fail", "skip").index(found[1])] += 1
    return out


def _outcome(part: str) -> int | None:
    """What became of a test case (passed, failed, skipped, error), or None while it is open."""
    if _CLOSED.match(part):
        return 0
    body, closed, _ = part.partition("</testcase")
    if not closed:
        return None
    has = lambda tag: re.search(rf"<{tag}[\s/>]", body, re.ASCII)
    return 3 if has("error") else 1 if has("failure") else 2 if has("skipped") else 0


def of_cases(text: str) -> tuple[Tally, str]:
    """The tally of the finished cases of a text, and what must be seen again with what follows."""
    out, starts = Tally(), [m.start() for m in _CASE.finditer(text)]
    rest = text[-len("<testcase") :]  # may be the start of a case
    for at, end in zip(starts, [*starts[1:], len(text)], strict=False):
        found = _outcome(text[at + len("<testcase") : end])
        if found is not None:
            out.junit[found] += 1
        elif end == len(text):
            rest = text[at:]
    return out, rest


@dataclass
class Output:
    """A run's output so far: what is counted, the line and the case that are not whole yet."""

    tally: Tally = field(default_factory=Tally)
    line: str = ""
    case: str = ""

    def add(self, text: str) -> None:
        *lines, self.line = (self.line + text).split("\n")
        cases, self.case = of_cases(self.case + text)
        self.tally = self.tally.then(of_lines(lines)).then(cases)

    def counts(self, dialect: str) -> tuple[int, int, int, int]:
        """As of now: an unfinished line counts as it is."""
        return self.tally.then(of_lines([self.line])).counts(dialect)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Output:
        x = json.loads(text)
        return cls(Tally(**x["tally"]), x["line"], x["case"])
