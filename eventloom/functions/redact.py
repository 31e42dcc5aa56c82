"""Secret scanning and redaction of text and JSON columns.

Match offsets and JSON walks have no built-in, so they run in Arrow UDFs over the flat bytes of a batch
(see scan); counting uses built-in expressions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import SLICE_BYTES, Rule, Scanner

#: Rows of a slice of a batch at most.
SLICE_ROWS = 4096
# What counts as a secret, in the order in which patterns are tried.
PATTERNS = [
    ("api-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api-key", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("api-key", r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    ("api-key", r"\bxox[bpars]-[A-Za-z0-9-]{10,}\b"),
    ("api-key", r"\bsk_(?:live|test)_[A-Za-z0-9]{24,}\b"),
    ("api-key", r"\brk_(?:live|test)_[A-Za-z0-9]{24,}\b"),
    ("api-key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("jwt-like", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("authorization-header", r"(?i)\bauthorization\s*[:=]\s*(?:bearer|basic|token)\s+[A-Za-z0-9._\-=]{8,}"),
    ("bearer-token", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{16,}"),
    ("private-key-block", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("database-url", r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s@]+@[^/\s]+"),
    ("email-address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"),
    ("private-ip-address", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|127\.0\.0\.1)\b"),
    ("absolute-home-path", r"(?:/home/|/Users/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+"),
]
# What every match of a pattern contains (in lower case where it ignores case).
ANCHORS = dict(
    zip(
        (p for _, p in PATTERNS),
        [
            ("AKIA", "ASIA"),
            ("ghp_",),
            ("github_pat_",),
            ("xox",),
            ("sk_",),
            ("rk_",),
            ("AIza",),
            ("eyJ",),
            ("author",),
            ("bearer",),
            ("-----BEGIN ",),
            ("://",),
            ("@",),
            ("10.", "192.168.", "172.", "127.0.0.1"),
            ("/home/", "/Users/", ":\\Users\\"),
        ],
        strict=True,
    )
)
FINDINGS = "array<struct<kind:string,span_start:long,span_end:long,redaction:string,preview:string>>"
REDACTED = f"struct<redacted:string,findings:{FINDINGS}>"


def count_secrets(text: Column, kind: str, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """Matches of one kind's patterns, each pattern on its own."""
    return sum((F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for k, p in patterns if k == kind), F.lit(0)).cast("long")


def mask_preview(value: Column, kind: Column) -> Column:
    """What may be shown of a secret."""
    n = F.octet_length(value)
    parts = F.split(value, r"\.")
    email = F.when(F.instr(value, "@") > 0, F.concat(F.substring(value, 1, 1), F.lit("***@"), F.regexp_extract(value, "@(.*)$", 1))).otherwise(F.concat(F.substring(value, 1, 1), F.lit("***")))
    ip = F.when(F.size(parts) == 4, F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.lit("x"), F.lit("x"))).otherwise("x.x.x.x")
    other = F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.least(n - 6, F.lit(8))), F.substring(value, -2, 2))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).when(kind == "email-address", email).when(kind == "private-ip-address", ip).when(kind == "absolute-home-path", "~").otherwise(other)


def _preview(value: str, kind: str) -> str:
    n = len(value.encode())
    if n <= 4:
        return "*" * n
    if kind == "email-address":
        return f"{value[0]}***@{value.split('@', 1)[1]}" if "@" in value else f"{value[0]}***"
    if kind == "private-ip-address":
        return ".".join([*value.split(".")[:2], "x", "x"])
    if kind == "absolute-home-path":
        return "~"
    return value[:2] + "*" * min(max(n - 6, 0), 8) + value[-2:]


def tag(kind: str, key: str, number: int) -> str:
    """A redaction tag; its suffix tells findings apart and depends on the row's key, not on the secret."""
    return f"<REDACTED:{kind.upper()}:{hashlib.sha256(f'{key}:{number}'.encode()).hexdigest()[:6]}>"


_FINDING = pa.struct([("kind", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("redaction", pa.string()), ("preview", pa.string())])


class _Redactor:
    """Findings and redacted texts of an Arrow column."""

    def __init__(self, patterns: list[tuple[str, str]]):
        self.kinds = [k for k, _ in patterns]
        self.scanner = Scanner([Rule(p, ANCHORS.get(p, ())) for _, p in patterns])

    def texts(self, column: pa.Array, keys: list[str] | None = None, owner: list[int] | None = None) -> tuple[pa.Array, list[tuple]]:
        """The column with tags for secrets, and (row, kind, start, end, tag, preview) of each finding, by row.

        Tags of rows of one owner (else of each row) are numbered on; keys are those of owners."""
        found, chunks, last, number = [], [], -1, 0
        for lo, raw, off in self.scanner.slices(column):
            parts, at, more = [], 0, np.zeros(len(off), np.int64)
            for t, start, end, i in self.scanner(raw, off):
                whose = lo + t if owner is None else owner[lo + t]
                number, last = (number + 1 if whose == last else 0), whose
                mark, value, first = tag(self.kinds[i], keys[whose], number), raw[start:end].decode(), int(off[t])
                found.append((lo + t, self.kinds[i], start - first, end - first, mark, _preview(value, self.kinds[i])))
                parts += [raw[at:start], mark.encode()]
                more[t + 1] += len(mark) - (end - start)
                at = end
            data = b"".join([*parts, raw[at:]])
            chunks.append(pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off + np.cumsum(more)), pa.py_buffer(data)]))
        made = pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())
        return pc.if_else(column.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string()), found


def _findings(rows: list[int], found: list[tuple], n: int) -> pa.Array:
    """A list of findings for each of n rows; found is in their order."""
    columns = list(zip(*found, strict=True))[1:] if found else [()] * 5
    values = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FINDING, strict=True)], fields=list(_FINDING))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(np.array(rows, np.int64), minlength=n))], pa.int32()), values)


def _in_slices(one: Callable[[pa.Array, pa.Array], pa.Array]) -> Callable:
    """`one` over runs of a batch's rows of SLICE_BYTES about (one row at least): what is made on the way, such
    as parsed values, is that of a slice, however many rows and bytes a batch has."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        made, lo = [], 0
        while lo < len(texts) or not made:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))), len(texts), lo + SLICE_ROWS)
            made.append(one(texts[lo:hi], keys[lo:hi]))
            lo = hi
        out = pa.concat_arrays(made)
        del made
        pa.default_memory_pool().release_unused()
        return out

    return run


def scan_secrets(text: Column, key: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """The findings of a text; spans are byte offsets in it.  A null text has none."""
    redactor = _Redactor(patterns)

    def one(texts: pa.Array, keys: pa.Array) -> pa.Array:
        _, found = redactor.texts(texts, _Keys(keys))
        return _findings([f[0] for f in found], found, len(texts))

    return F.arrow_udf(_in_slices(one), FINDINGS)(text, key.cast("string"))


def redact_text(text: Column, key: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """Struct (redacted, findings) of a text; spans are byte offsets in the input."""
    redactor = _Redactor(patterns)

    def one(texts: pa.Array, keys: pa.Array) -> pa.Array:
        redacted, found = redactor.texts(texts, _Keys(keys))
        return pa.StructArray.from_arrays([redacted, _findings([f[0] for f in found], found, len(texts))], ["redacted", "findings"])

    return F.arrow_udf(_in_slices(one), REDACTED)(text, key.cast("string"))


class _Keys:
    """Keys of rows, looked up one by one."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __getitem__(self, row: int) -> str:
        return str(self.column[row].as_py())


def _strings(value) -> Iterator[str]:
    """String values at any depth, in order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _strings(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from _strings(x)


def _replaced(value, new: Iterator[str]):
    """value with its strings taken from `new`, in the same order."""
    if isinstance(value, str):
        return next(new)
    if isinstance(value, list):
        return [_replaced(x, new) for x in value]
    if isinstance(value, dict):
        return {k: _replaced(v, new) for k, v in value.items()}
    return value


def _parsed(text: str) -> tuple[bool, object]:
    """Whether a payload is JSON, and its value (else the text)."""
    try:
        return True, json.loads(text)
    except ValueError:
        return False, text


def redact_json(payload: Column, key: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """Struct (redacted, findings): string values at any depth are redacted, keys are not.

    A payload that is not JSON is redacted as text.  The strings of all payloads of a slice of a batch are scanned together."""
    redactor = _Redactor(patterns)

    def one(texts: pa.Array, keys: pa.Array) -> pa.Array:
        values = [None if t is None else _parsed(t) for t in texts.to_pylist()]
        parts = [[] if v is None else list(_strings(v[1])) for v in values]
        owner = [i for i, p in enumerate(parts) for _ in p]
        redacted, found = redactor.texts(pa.array([x for p in parts for x in p], pa.large_string()), _Keys(keys), owner)
        rows = [owner[f[0]] for f in found]
        hit, first = set(rows), np.r_[0, np.cumsum([len(p) for p in parts])].tolist()
        out = []
        for i, v in enumerate(values):
            if v is not None and i in hit:
                v = (v[0], _replaced(v[1], iter(redacted[first[i] : first[i + 1]].to_pylist())))
            out.append(None if v is None else json.dumps(v[1], ensure_ascii=False, separators=(",", ":")) if v[0] else v[1])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), _findings(rows, found, len(values))], ["redacted", "findings"])

    return F.arrow_udf(_in_slices(one), REDACTED)(payload, key.cast("string"))


def redact_payload(events: DataFrame, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """events with a redacted payload and a column of findings."""
    got = events.withColumn("__r", redact_json(F.col("payload"), F.col("event_id"), patterns))
    return got.withColumns({"payload": F.col("__r.redacted"), "findings": F.col("__r.findings")}).drop("__r")


def findings_table(events: DataFrame) -> DataFrame:
    return events.select("session_id", "event_id", F.explode("findings").alias("f")).select("session_id", "event_id", "f.*")


def count_findings(events: DataFrame) -> DataFrame:
    return events.select("session_id", "event_id", F.size("findings").cast("long").alias("n_findings"))
