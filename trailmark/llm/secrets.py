"""Secrets in texts: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer turns ``name = literal``, ``name: literal``, ``"name": "literal"``, ``name => literal``,
``NAME := literal`` and ``<name>literal</name>`` into name-literal pairs. A bare name on the
right is a reference; the literals it is given anywhere in the text are carried over, also through
several steps and through ``+``. A literal is scored by the most sensitive name it reaches and by
how little it looks like a word or a placeholder.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, once, table, unused

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pair")
#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: How sensitive a target name is, by its parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "bearer": 0.9, "auth": 0.7, "authorization": 0.8,
    "key": 0.7, "signature": 0.6, "salt": 0.6, "pin": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)\A(?:none|null|true|false|undefined|change_?me|example\w*|your\w*|x{3,}|\*+|\.+|<.*>|\$?\{.*\}|%\w+%)\Z")
#: Literals of this score or more are spans of kind pair.
LEAST_SCORE = 0.5
LEAST_LITERAL = 8
#: Most code points of plain words in quotes that count for a fully sensitive name.
MOST_PLAIN = 128

_SEPARATOR = re.compile(r":=|=>|[:=]")
_NOT_ASSIGNED = re.compile(r"[=!<>:]=|::|://")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>")
_QUOTED = re.compile(r"""[rbfuRBFU]{0,2}(?:\"\"\"(?P<a>.*?)\"\"\"|'''(?P<b>.*?)'''|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)')""", re.DOTALL)
_BARE = re.compile(r"""[^\s,;(){}\[\]"'<>#&]+""")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret itself) of the fixed patterns."""
    found = [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return found


def _target(text: str, at: int) -> str | None:
    """The name that ends before the separator at ``at``."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    quote = text[end - 1] if end and text[end - 1] in "\"'`]" else ""
    if quote == "]" and end > 1 and text[end - 2] in "\"'":  # name["key"] = literal
        end -= 1
        quote = text[end - 1]
    end -= bool(quote)
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-$"):
        start -= 1
    name = text[start:end].strip(".-$")
    return name or None


def _operands(text: str, at: int) -> list[tuple[str, int, int]]:
    """(literal or name, start, end) of what stands right of a separator, parts joined by + in turn."""
    out, n = [], len(text)
    while True:
        while at < n and text[at] in " \t":
            at += 1
        if m := _QUOTED.match(text, at):
            k = m.lastgroup
            out.append(("literal", m.start(k), m.end(k)))
        elif m := _BARE.match(text, at):
            end = m.end() - len(m[0]) + len(m[0].rstrip(".:!?"))
            out.append(("name" if _NAME.match(text[at:end]) else "literal", at, end))
        else:
            return out
        if not (plus := _PLUS.match(text, m.end())):
            return out
        at = plus.end()


def assignments(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Every (target name, operands) in order of the text."""
    found = []
    for m in _SEPARATOR.finditer(text):
        i = m.start()
        if m[0] in ":=" and (_NOT_ASSIGNED.match(text, i) or _NOT_ASSIGNED.match(text, i - 1)) and i:
            continue
        if (name := _target(text, i)) and (right := _operands(text, m.end())):
            found.append((i, name, right))
    if "</" in text:
        found += [(m.start(), m[1], [("literal", *m.span(2))]) for m in _ELEMENT.finditer(text)]
    return [(name, right) for _, name, right in sorted(found)]


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


def literal_score(value: str) -> float:
    """0 for placeholders, short values and plain words, towards 1 for random-looking ones."""
    if len(value) < LEAST_LITERAL or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search(r"[^A-Za-z0-9]", value))))
    if kinds < 2:
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, bits / 4 + (kinds - 2) * 0.15)


def sensitivity(found: list[tuple[str, list[tuple[str, int, int]]]], text: str) -> dict[str, float]:
    """For every target name the highest score of the names that its values reach, itself included.

    A value reaches a name that it is assigned to, and whatever that name is assigned to in turn,
    over all assignments of the text. The most sensitive names hand their score on first, so
    every name gets its score once, however references run in circles.
    """
    targets = {name for name, _ in found}
    taken_from: dict[str, set[str]] = {}
    for name, right in found:
        taken_from.setdefault(name, set()).update({text[a:b] for kind, a, b in right if kind == "name"} & targets)
    out: dict[str, float] = {}
    for score, name in sorted(((name_score(n), n) for n in targets), reverse=True):
        todo = [name]
        while todo:
            if (n := todo.pop()) not in out:
                out[n] = score
                todo += taken_from[n]
    return out


def pair_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Literals whose score, by the names they reach, is high enough.

    A bare name that nothing is assigned to counts as a literal, as in NAME=value. What a fully
    sensitive name is given in quotes counts unless it is short or a placeholder, however plain.
    """
    found = assignments(text)
    reaches = sensitivity(found, text)
    scores: dict[tuple[int, int], float] = {}
    for name, right in found:
        if not (score := reaches[name]):
            continue
        for kind, a, b in right:
            if kind == "name" and text[a:b] in reaches:
                continue
            own = score * literal_score(text[a:b])
            if score >= 1 and a and text[a - 1] in "\"'" and text[b : b + 1] == text[a - 1]:
                own = max(own, plain_score(text[a:b]))
            scores[a, b] = max(scores.get((a, b), 0.0), own)
    return [("pair", a, b, a, b) for (a, b), score in scores.items() if score >= LEAST_SCORE]


def plain_score(value: str) -> float:
    """Whether words in quotes can be a secret: one line that is neither short nor a placeholder."""
    fits = LEAST_LITERAL <= len(value) <= MOST_PLAIN and "\n" not in value and value.strip() and not PLACEHOLDER.match(value)
    return LEAST_SCORE if fits else 0.0


def spans_of(text: str) -> list[tuple[str, int, int, int, int]]:
    """All spans by start, then kind as listed; a pair inside a base span is not repeated."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    pairs = pair_spans(text) if _SEPARATOR.search(text) or "</" in text else []
    furthest, at, apart = -1, 0, []
    for p in sorted(pairs, key=lambda s: s[1]):
        while at < len(base) and base[at][1] <= p[1]:
            furthest = max(furthest, base[at][2])
            at += 1
        if furthest < p[2]:
            apart.append(p)
    return sorted(base + apart, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_FIELDS = ("kind", "start", "end", "value_start", "value_end")
_SPAN = pa.struct([("kind", pa.string()), *((f, pa.int32()) for f in _FIELDS[1:])])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(f, T.IntegerType()) for f in _FIELDS[1:])]))


@F.arrow_udf(_SPANS)
def find_spans(texts: pa.Array) -> pa.Array:
    rows = [[dict(zip(_FIELDS, s, strict=True)) for s in spans_of(t or "")] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(_SPAN))


def masked(text: str) -> str:
    """The text with the secret part of every span replaced; overlapping parts become one mark."""
    kept, at = [], 0
    for a, b in sorted(s[3:] for s in spans_of(text)):
        if b > at:
            if a >= at:
                kept += [text[at:a], MASK]
            at = b
    return "".join([*kept, text[at:]])


@F.arrow_udf(T.StringType())
def mask(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else masked(t) for t in texts.to_pylist()], pa.string())


#: What stands in a text in place of a secret.
MASK = "[SECRET]"


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secret_spans: kind, start, end (code points, end exclusive) and the secret's own part.

    A null text has no spans. Repeated rows are scanned each. A column of that name is replaced.
    An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn("secret_spans", once(find_spans)(F.col(text)))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark; n_chars follows the text.

    A null text stays null, repeated rows stay, other columns stay whatever their names. An empty
    table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    clean = unused("_clean", docs)
    out = docs.withColumn(clean, once(mask)("text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(clean) != F.col("text"), F.length(clean).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return out.withColumn("text", F.col(clean)).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op4_secret_scans")
def op4_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    counts = [_of_kind(spans, k).alias(f"n_{k}") for k in KINDS]
    base = F.filter(spans, lambda s: s["kind"] != "pair")
    return scan_secrets(docs).select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )
