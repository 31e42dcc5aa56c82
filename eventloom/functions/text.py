"""Text columns: failure signatures, SQL templates, identifiers, paths, test output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise in messages and what stands for it, applied in this order.
NOISE = [
    (r"\b0x[0-9a-fA-F]{4,}\b", "<HEX>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\bpid\s*=\s*\d+\b", "<PID>"),
    (r"([\w./-]+\.[a-zA-Z]{1,8}):(\d+)(?::(\d+))?", "$1:<LINE>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"""(?:[A-Z]:\\(?:Users|Windows|ProgramData|Program Files)[^\s"']+)""", "<WINPATH>"),
    (r"""/(?:home|Users|tmp|var|opt|root|srv)/[^\s"']+""", "<PATH>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<TIME>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>"),
    (r"\b\d{2,}\b", "<NUM>"),
]
# What marks a line of a stack trace, at its start or anywhere.
FRAME_STARTS = ["at ", "File ", "0:", "1:", "2:"]
FRAME_PARTS = [" at ", "Traceback", ".rs:", ".ts:", ".js:", ".py:", ".java:", ".kt:", ".go:", "(most recent call last)"]
# Names of variables that hold secrets.
SECRET_NAMES = ["PASSWORD", "PASSWD", "SECRET", "TOKEN", "API_KEY", "APIKEY", "ACCESS_KEY", "PRIVATE_KEY", "CLIENT_SECRET", "AUTH_TOKEN"]


def normalise_message(message: Column) -> Column:
    for pattern, mark in NOISE:
        message = F.regexp_replace(message, pattern, mark)
    return message


def _is_frame(line: Column) -> Column:
    tests = [line.startswith(x) for x in FRAME_STARTS] + [line.contains(x) for x in FRAME_PARTS]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def top_frames(trace: Column, n: int = 6) -> Column:
    """The first n lines of a trace that look like frames, normalised."""
    lines = F.filter(F.transform(F.split(F.coalesce(trace, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & _is_frame(x))
    return F.transform(F.slice(lines, 1, n), normalise_message)


def failure_signature(kind: Column, message: Column, trace: Column, exit_code: Column, component: Column) -> Column:
    return F.struct(kind.alias("exception_kind"), normalise_message(message).alias("normalised_message"), top_frames(trace).alias("top_frames"), exit_code.alias("exit_code"), component.alias("component"))


def signature_key(signature: Column) -> Column:
    """Kind, message, frames, exit code and component in lower case, joined by a bar."""
    s = signature
    parts = F.concat(F.array(s["exception_kind"], s["normalised_message"]), s["top_frames"], F.array(F.coalesce(s["exit_code"].cast("string"), F.lit("none"))), F.filter(F.array(s["component"]), lambda x: x.isNotNull()))
    return F.lower(F.array_join(parts, "|"))


def scene_signature(scene: Column, message: Column) -> Column:
    return F.struct(F.lit("godot.script_error").alias("exception_kind"), normalise_message(message).alias("normalised_message"), F.array(F.concat(F.lit("scene:<"), normalise_message(scene), F.lit(">"))).alias("top_frames"), F.lit(None).cast("int").alias("exit_code"), F.lit("godot").alias("component"))


def normalize_sql(sql: Column) -> Column:
    """A statement's template: literals become ?, white space single spaces."""
    for pattern, mark in (("'[^']*'", "?"), (r"\b\d+\b", "?"), (r"\?+", "?"), (r"\s+", " ")):
        sql = F.regexp_replace(sql, pattern, mark)
    return F.trim(sql)


def is_ulid(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike("^[0-7][0-9a-hjkmnp-tv-z]{25}$")


def mask_path(path: Column, root: Column) -> Column:
    """A path within the project, or with the home directory cut."""
    inner = F.regexp_replace(F.substring(path, F.length(root) + 1, F.length(path)), r"^[\\/]+", "")
    home = r"^(?:/home/|/Users/|[Cc]:\\Users\\|c:\\users\\)[^\\/]*"
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return F.when(path.startswith(root) & (inner != ""), F.concat(F.lit("/$PROJECT/"), slashes(inner))).when(path.rlike(home), F.concat(F.lit("~"), slashes(F.regexp_replace(path, home, "")))).otherwise(path)


def is_secret_name(name: Column) -> Column:
    u = F.upper(name)
    return u.isin(*SECRET_NAMES) | u.contains("SECRET") | u.contains("PASSWORD") | u.endswith("_TOKEN") | u.endswith("_KEY") | u.endswith("_PASSWORD")


def http_severity(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def exit_severity(code: Column) -> Column:
    return F.when(code == 0, "info").otherwise("warning")


def fs_action(kind: Column) -> Column:
    return F.when(kind == "create", "create").when(kind == "modify", "modify").when(kind == "remove", "remove").when(kind.isin("rename", "modify.name"), "rename").when(kind == "any", "other")


def extension(path: Column) -> Column:
    found = F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)
    return F.when(found != "", found)


def _count_before(line: Column, word: str) -> Column:
    """The last number that stands before the first `word` of a line."""
    head = F.when(F.instr(F.lower(line), word) > 0, F.substring_index(F.lower(line), word, 1))
    found = F.regexp_extract(head, r"(\d+)[^0-9]*$", 1)
    return F.when(found != "", found.cast("long"))


def _case(body: Column) -> Column:
    """What became of a test case of an XML report: an error counts before a failure, this before a skip."""
    has = lambda tag: body.rlike(rf"<{tag}[\s/>]")
    return F.when(has("error"), "error").when(has("failure"), "fail").when(has("skipped"), "skip").otherwise("pass")


def test_counts(text: Column, dialect: str) -> Column:
    """Struct (passed, failed, skipped, inconclusive) from a test run's whole output."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    zero = F.lit(0).cast("long")
    pack = lambda p, f, s, i=zero: F.struct(*[F.coalesce(c, zero).cast("long").alias(n) for c, n in ((p, "passed"), (f, "failed"), (s, "skipped"), (i, "inconclusive"))])
    if dialect == "pytest":
        hits = F.filter(lines, lambda x: x.contains(" in ") & (x.contains("passed") | x.contains("failed") | x.contains("error")))
        last = F.get(hits, F.size(hits) - 1)
        return pack(*[_count_before(last, w) for w in ("passed", "failed", "skipped", "error")])
    size = lambda test: F.size(F.filter(lines, test))
    if dialect == "vitest":
        tick = lambda x: x.contains("✓")
        total = F.get(F.filter(lines, lambda x: F.trim(x).startswith("Tests:")), F.lit(0))
        marks = (size(tick), size(lambda x: ~tick(x) & (x.contains("✗") | x.contains("×"))), zero)
        return pack(*[F.coalesce(_count_before(total, w), m) for w, m in zip(("passed", "failed", "skipped"), marks, strict=True)])
    if dialect == "gotest":
        mark = lambda x: F.when(F.trim(x).startswith("--- PASS: "), "pass").when(F.trim(x).startswith("--- FAIL: "), "fail").when(F.trim(x).startswith("--- SKIP: "), "skip").otherwise(F.regexp_extract(x, r'"Action":"(pass|fail|skip)"', 1))
        marks = F.transform(lines, mark)
        count = lambda w: F.size(F.filter(marks, lambda x: x == w))
        return pack(*map(count, ("pass", "fail", "skip")))
    if dialect == "junit":
        cases = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"<testcase(?=[\s/>])"), 2, 1 << 30), lambda x: F.when(x.rlike(r"^[^>]*/\s*>"), "pass").when(x.contains("</testcase"), _case(F.substring_index(x, "</testcase", 1))))
        count = lambda w: F.size(F.filter(cases, lambda x: x == w))
        return pack(*map(count, ("pass", "fail", "skip", "error")))
    if dialect == "auto":
        each = [test_counts(text, d) for d in ("pytest", "vitest", "gotest", "junit")]
        return pack(*[F.greatest(*[e[c] for e in each]) for c in ("passed", "failed", "skipped")])
    raise ValueError(f"unknown dialect: {dialect}")
