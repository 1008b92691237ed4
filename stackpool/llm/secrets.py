"""Secret scan: three base patterns, and assignment-aware lexing of source and configuration text.

One pass from left to right over the lines that hold a separator (``=``, ``:``,
``:=``, ``=>``) or an element reads names, quoted literals (single and triple
quotes), brackets and operators.  A name (or a quoted key, or the index of a
subscript) before a separator gets the value behind it: quoted literals and names
joined by ``+``, or one bare word.  ``name: Type = value`` is one assignment, the
type is not its value.  ``<name>value</name>`` and ``key="name" value="..."`` are
assignments too.  A name in a value stands for what it was assigned last before
that place, or first behind it if it was not yet.  A literal is scored by the words
of every name that it reaches and by its own shape.  Scopes are not told apart.
Time is linear in the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.llm.common import by_rows, id_text

# The base patterns, kinds in this order.
KINDS = ("assign", "access", "hex", "pair")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_TOKEN = re.compile(r"""
    (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.\-$]+[A-Za-z0-9_]+)*)
  | (?P<quote>\"{3}|\'{3}|["'`])
  | (?P<sep>:=|=>|(?<![=!<>:+\-*/%&|^~])=(?![=~])|(?<!:):(?![:/=]))
  | (?P<line>\n)
""", re.X)
# what follows an opening quote; the quote itself is the group's name
_CLOSED = {q: re.compile(p) for q, p in {
    '"': r'((?:[^"\\\n]|\\.)*+)"', "'": r"((?:[^'\\\n]|\\.)*+)'", "`": r"([^`\n]*+)`",
    '"""': r'([\s\S]*?)"""', "'''": r"([\s\S]*?)'''"}.items()}
_BLANK = re.compile(r"[ \t]*")
_PLUS = re.compile(r"[ \t]*(?:\+[ \t]*(?:\\?\r?\n[ \t]*)?|\\\r?\n[ \t]*)")
_OPERAND = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.\-]*+)\}?(?![A-Za-z0-9+/=@%$!#^&*~?:|\\(\[])")
_TYPE = re.compile(r"[A-Za-z_][\w.\[\]<>|?, ]{0,80}?(?==)")
_BARE = re.compile(r"([^\s\"'`,;(){}\[\]<>=:]++(?::[^\s\"'`,;(){}\[\]<>=:]++)*+)(={0,2})(?![^\s\"'`,;){}\]<>])")
_RUN = re.compile(r"[^\s\"'`,;(){}\[\]<>=]*+")
_KEY = re.compile(r"[\w.$ \-]{1,64}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]{0,63})>([^<>\n]++)</(?=([A-Za-z_][\w.\-]{0,63})>)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_PREFIXES = frozenset(("b", "r", "f", "u", "br", "rb", "fr", "rf"))

#: Weight of a word in a name; a literal needs THRESHOLD in all.
NAME_WEIGHT = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5, "credential": 2.5,
               "credentials": 2.5, "apikey": 3.0, "auth": 1.5, "private": 1.5, "access": 1.0, "api": 1.0, "client": 0.5, "signing": 1.0,
               "encryption": 1.0, "key": 1.5, "salt": 1.0, "bearer": 2.0, "cookie": 1.0, "session": 1.0}
THRESHOLD = 4.0
PLACEHOLDERS = frozenset(("changeme", "example", "password", "secret", "placeholder", "none", "null", "true", "false", "undefined", "todo", "required", "[secret]"))


def name_weight(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    return sum(NAME_WEIGHT.get(w, 0.0) for w in set(words))


def shape_weight(literal: str) -> float:
    """Up to 3 for a literal that looks drawn at random; -10 for one that cannot be a secret."""
    n = len(literal)
    if n < 6 or any(c.isspace() for c in literal) or literal.lower() in PLACEHOLDERS or len(set(literal)) < 4:
        return -10.0
    counts = Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    return min(1.5, max(0.0, entropy - 2.0) * 0.75) + (0.5 * (kinds - 1) if kinds > 1 else -0.5) + (0.5 if n >= 16 else 0.0)


def _literal(text: str, at: int, stuck: dict[str, int]) -> tuple[int, int, int] | None:
    """(start, end, place behind) of the quoted literal that opens at ``at``; ``stuck`` tells up to where a quote is known not to close."""
    quote = text[at:at + 3] if text[at:at + 3] in ('"""', "'''") else text[at]
    if at < stuck.get(quote, 0):
        quote = text[at]
    if at < stuck.get(quote, 0):
        return None
    if m := _CLOSED[quote].match(text, at + len(quote)):
        return m.start(1), m.end(1), m.end()
    end = text.find("\n", at) if len(quote) == 1 else -1
    stuck[quote] = len(text) if end < 0 else end
    return _literal(text, at, stuck) if len(quote) == 3 else None


def _value(text: str, at: int, stuck: dict[str, int]) -> tuple[list[tuple[int, int]], list[str], bool, int]:
    """(spans of literals, names, whether the one name may be a bare word, place to go on from) of the value at ``at``."""
    spans, names = [], []
    start = at = _BLANK.match(text, at).end()
    while at < len(text):
        if text[at] in "\"'`":
            found = _literal(text, at, stuck)
            if not found:
                break
            spans.append(found[:2])
            at = found[2]
        elif m := _OPERAND.match(text, at):
            names.append(m.group(1))
            at = m.end()
        else:
            break
        joined = _PLUS.match(text, at)
        if not joined:
            break
        at = joined.end()
    if spans:
        return [x for x in spans if x[0] < x[1]], names, False, at
    if names:
        # the name may be the target of the next assignment
        return [], names, len(names) == 1, start
    if m := _BARE.match(text, start):
        return [m.span()], [], False, m.end()
    # a word that a separator follows: go on at the last name in it
    run = _RUN.match(text, start).group()
    return [], [], False, start + max(run.rstrip(":").rfind(":"), 0)


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[str], tuple[int, int] | None]]:
    """All (name, literal spans, names of the value, span of a lone name) that the text assigns, in order."""
    out: list[tuple[str, list[tuple[int, int]], list[str], tuple[int, int] | None]] = []
    stuck: dict[str, int] = {}
    ahead = {"=": -1, ":": -1}
    at, name, name_end, key = 0, "", -1, ""
    while m := _TOKEN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "name":
            name, name_end = m.group(), at
        elif kind == "line":
            name, key = "", ""
            # on to the next line that can hold an assignment
            for c, place in ahead.items():
                if place < at:
                    found_at = text.find(c, at)
                    ahead[c] = len(text) if found_at < 0 else found_at
            at = max(at, text.rfind("\n", at, min(ahead.values())))
            if min(ahead.values()) == len(text):
                break
        elif kind == "quote":
            opened = m.start()
            if opened and text[opened - 1].isalnum() and not (opened == name_end and name.lower() in _PREFIXES):
                continue  # an apostrophe
            found = _literal(text, opened, stuck)
            if not found:
                at = opened + 1
                continue
            a, b, at = found
            name = text[a:b].strip() if _KEY.fullmatch(text, a, b) else ""
            name_end = at + 1 if text[at:at + 1] == "]" else at
        elif name and not text[name_end:m.start()].strip(" \t?"):
            kind = ""
            if m.group() == ":" and (t := _TYPE.match(text, _BLANK.match(text, at).end())) and text[t.end() + 1:t.end() + 2] not in ("=", ">", "~"):
                kind, at = t.group().strip(), t.end() + 1
            target = key if name.lower() == "value" and key else name
            here = _BLANK.match(text, at).end()
            spans, names, bare, at = _value(text, at, stuck)
            if name.lower() in ("key", "name") and len(spans) == 1 and _KEY.fullmatch(text, *spans[0]):
                key = text[slice(*spans[0])]
            if spans or names:
                lone = (here, here + len(names[0])) if bare and text.startswith(names[0], here) else None
                # what looks like a type may be the assigned name: "log: password=..."
                out += [(n, spans, names, lone) for n in ((target, kind) if kind and name_weight(kind) else (target,))]
            name = ""
        else:
            name = ""
    if "</" in text:
        out += [(m.group(1), [m.span(2)], [], None) for m in _ELEMENT.finditer(text) if m.group(1) == m.group(3)]
    return out


def method_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose names and shape speak for a secret."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found = pairs(text)
    first: dict[str, int] = {}
    for i, (name, *_) in enumerate(found):
        first.setdefault(name, i)
    # the assignments whose values each assignment takes over
    last: dict[str, int] = {}
    sources: list[list[int]] = []
    for i, (name, _, names, _) in enumerate(found):
        sources.append([last.get(n, first.get(n, i)) for n in names])
        last[name] = i
    # heaviest first, each assignment is reached once
    own = [name_weight(name) for name, *_ in found]
    weight = [0.0] * len(found)
    for i in sorted((i for i, w in enumerate(own) if w > 0), key=lambda i: -own[i]):
        todo = [i]
        while todo:
            j = todo.pop()
            if not weight[j]:
                weight[j] = own[i]
                todo += sources[j]
    out = set()
    for (_, spans, names, lone), w in zip(found, weight):
        if lone and names[0] not in first and "." not in names[0] and any(c.isdigit() for c in names[0]):
            spans = [lone]
        if spans and w > 0 and w + shape_weight("".join(text[a:b] for a, b in spans)) >= THRESHOLD:
            out.update(spans)
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns: leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + [(a, 3, b) for a, b in method_spans(text)])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every covered stretch replaced by ``mark``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        parts += [text[at:a], mark]
        at = b
    return "".join(parts) + text[at:]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and all spans (lists of start, kind, end in code points).

    A null text is empty and has no spans; repeated rows are scanned each for itself; a text of any length takes
    time linear in it.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def rows(ids, texts):
        both = [scan(t or "") for t in texts]
        as_rows = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x] for x in side] for side in zip(*both)] or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(as_rows[0], span), pa.array(as_rows[1], span)], ["doc_id", "base", "spans"])
    fn, schema = by_rows(rows, "doc_id long, base array<struct<start long, kind string, end long>>, spans array<struct<start long, kind string, end long>>")
    return id_text(docs, id_col, text_col).mapInArrow(fn, schema)


def span_text(column: str):
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced; ``length_col``, if there, follows the text.

    A null text stays null.
    """
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, scan(t)[1]))
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
