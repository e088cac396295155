"""Secret scans (9): assignment-aware lexing of source and configuration text into name-literal pairs.

A text is lexed into name-literal pairs: assignments, mappings, environment exports, dotted properties, attributes and
elements of XML, and block scalars of YAML. Before the operator there may be quotes, a subscript or a type; a macro's name, or
the first argument of a call, names the literal behind it. A literal is read from its operator on, in brackets or on the next
line too: to its closing quote, escapes and triple quotes minded, or bare to white space or a delimiter; what it holds is lexed
in turn (connection strings, escaped JSON), however deep. String constants are propagated through later `name = other_name`,
`a + b`, `name += b` and through names that strings embed. A bare word that reads as a name, an attribute or a call stands for
what is known by that name, and is no literal otherwise. Each literal is scored by the sensitivity of its target name, its
length, alphabet and entropy. Literals that score enough give a span of kind `name`. Three base patterns (assign, access, hex)
always stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, strings, text_or_empty

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Each base assignment has one of these letters' groups somewhere; a text with none is not searched.
_HINT = re.compile(rb"(?i)passw|secret|token|api_?key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "name")

#: name and operator; the literal is read on its own from there. Names: in quotes or plain (then with a type, or brackets, behind), a subscript, a macro's, the first argument of a call.
_TYPE = r"[A-Za-z_&*][\w.:<>\[\]|&*?']*+(?:[ \t]++[\w.<>\[\]|&*?']++){0,2}+"
_OPERATOR = r"(?::=|=>|\?=|\+=|\|\|=|\.=|[:=])(?!=)"
_PAIR = re.compile(
    rf"""(?<![\w.$-])(?:\\?["'])?(?P<plain>[A-Za-z_$][\w.$-]*+)(?:\\?["'])?(?:\[[ \t]*+\w*+[ \t]*+\])?[ \t]*+(?:(?::[ \t]*+{_TYPE}[ \t]++|(?:string|String|str)[ \t]++)=[ \t]++|(?P<op>{_OPERATOR})[ \t]*+)|"""
    rf"""\[[ \t]*+\\?["'](?P<sub>[A-Za-z_$][\w.$-]*+)\\?["'][ \t]*+\][ \t]*+{_OPERATOR}[ \t]*+|"""
    r"""#[ \t]*+define[ \t]++(?P<macro>[A-Za-z_]\w*+)[ \t]++(?=["'])|"""
    r"""\([ \t]*+["'](?P<arg>[A-Za-z_$][\w.$-]*+)["'][ \t]*+,[ \t]*+(?=["'])"""
)
#: what may stand between an operator and a quoted literal: an opening bracket, a line's end; a literal's prefix
_OPENING = re.compile(r"""(?:[ \t]*+(?:\\?\n|[(\[])){1,3}+[ \t]*+(?=[rRbBuUfF]{0,2}["'`])""")
_ENDING = re.compile(r"[ \t]*+(?:[)\],;+]|\\?\n|\Z)")
#: Bare words longer than this are literals of sensitive names only.
LONG_BARE = 4096
_PREFIX = re.compile(r"""[rRbBuUfF]{1,2}+(?=["'])""")
#: a name within a string: {name}, ${name} and $name
_EMBEDDED = re.compile(r"\$?\{([A-Za-z_]\w*+)\}|\$([A-Za-z_]\w*+)")
#: words of letters, parts joined by dots and underscores, digits at the ends of parts only: names, attributes, types
_READS_AS_NAME = re.compile(r"[$_]*+(?:[A-Z]++[a-z]*+|[a-z]++)+[0-9]{0,2}(?:(?:\.|->|::|_)+(?:[A-Z]++[a-z]*+|[a-z]++)+[0-9]{0,2})*+_*+$")
#: triple quotes, and quotes (plain, then themselves escaped)
_LITERAL = re.compile(
    r'"""(?P<t1>(?:[^"\\]|\\.|"(?!""))*+)"""|' + r"'''(?P<t2>(?:[^'\\]|\\.|'(?!''))*+)'''|" + r'"(?P<q1>(?:[^"\\\n]|\\.)*+)"|' + r"'(?P<q2>(?:[^'\\\n]|\\.)*+)'|`(?P<q3>[^`\n]*+)`|"
    + r'\\"(?P<e1>(?:[^"\\\n]|\\[^"\n])*+)\\"|' + r"\\'(?P<e2>(?:[^'\\\n]|\\[^'\n])*+)\\'",
    re.S,
)
_BARE = re.compile(r"""[^\s"'`(){}\[\],;<>]++""")
_NAME = re.compile(r"^[A-Za-z_$][\w.$-]*$")
_CONCAT = re.compile(r"""[ \t]*+("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[A-Za-z_$][\w.$]*+)[ \t]*+(?:\+|\.\.)[ \t]*+""")
#: a block scalar's mark, up to the end of its line
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+\n")
#: a tag with its attributes, and the text up to the next tag
_TAG = re.compile(r"""<([A-Za-z_][\w.:-]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>([^<]*+)""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*+)\s*+=\s*+(?:"([^"<]*+)"|'([^'<]*+)')""")
#: attributes that name a setting, and those that hold its value
_NAMING, _HOLDING = ("key", "name", "id", "property", "setting"), ("value", "content", "default")
_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
#: Words of a name that make its literal sensitive, with their weights.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.5, "private": 1.5, "key": 1.5, "access": 1.0, "client": 0.5,
    "signature": 1.5, "salt": 1.5, "session": 1.0, "cookie": 1.0, "encryption": 1.5, "api": 1.0, "pass": 2.0, "dsn": 1.5,
}
#: Words that make it harmless.
HARMLESS = {"public": 2.0, "example": 2.0, "test": 0.5, "name": 1.5, "file": 1.5, "path": 1.5, "url": 1.0, "length": 2.0, "type": 1.5, "id": 1.0, "hash": 0.5, "count": 2.0, "max": 1.5, "min": 1.5}
_PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%?|changeme|your[-_].*|example.*|placeholder|none|null|nil|true|false|undefined|todo)$")
_NAME_HINT = re.compile(r"(?i)pass|secret|token|key|cred|auth|pwd|private|salt|cookie|session|signature|dsn|bearer")


def name_parts(name: str) -> list[str]:
    """Lower-case words of an identifier: snake, kebab, dotted and camel case."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    joined = {"".join(parts[i : i + 2]) for i in range(len(parts) - 1)} - set(parts)
    good = sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined})
    return good - sum(HARMLESS.get(p, 0.0) for p in set(parts))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def literal_score(name: str, value: str) -> float:
    """How likely value, assigned to name, is a secret: 4 and more is reported."""
    sense = name_score(name)
    if sense <= 0 or len(value) < 6:
        return 0.0
    if _PRIVATE.match(value):
        return sense + 4
    if _PLACEHOLDER.match(value) or any(ch.isspace() for ch in value):
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return sense + min(2.0, entropy(value) / 2) + (mixed - 1) * 0.5 + (0.5 if len(value) >= 16 else 0.0)


def _block(text: str, line: int, at: int) -> tuple[str, int, int] | None:
    """The lines from at on that are indented more than the line that begins at line: joined without their line breaks, and their span."""
    own = len(text[line:at]) - len(text[line:at].lstrip(" "))
    parts, first, last = [], at, at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        row = text[at:end]
        if row.strip():
            indent = len(row) - len(row.lstrip(" "))
            if indent <= own:
                break
            if not parts:
                first = at + indent
            last = at + len(row.rstrip())
            parts.append(row.strip())
        at = end + 1
    return ("".join(parts), first, last) if parts else None


def tagged(text: str) -> Iterator[tuple[str, str, int, int]]:
    """name, literal and span of settings in XML: a value attribute by the tag's naming one, an element's text by that or by its name."""
    for m in _TAG.finditer(text):
        found = [(a[1].lower(), a[2], a.start(2)) if a[2] is not None else (a[1].lower(), a[3], a.start(3)) for a in _ATTRIBUTE.finditer(m[2])]
        name = next((v for k, v, _ in found if k in _NAMING), None)
        if name:
            yield from ((name, v, m.start(2) + s, m.start(2) + s + len(v)) for k, v, s in found if k in _HOLDING)
        body = m[3].strip()
        if body and text.startswith("</", m.end()):
            start = m.start(3) + m[3].index(body)
            yield name or m[1], body, start, start + len(body)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """name, literal (constants propagated), and the literal's span in the text.

    A right-hand side that is a name known by then gives that name's literal, at that literal's place; string parts joined
    by +, and names that a string embeds, give the joined literal, at the whole expression's place. A right-hand side that is
    no literal (an opening bracket, an unknown name, a call), or is itself a name with an operator, is searched for pairs from
    just behind the operator; a quoted one is lexed inside too.
    """
    todo = [(text, 0)]
    while todo:
        part, offset = todo.pop()
        for name, value, start, end, inner in _pairs_of(part):
            yield name, value, start + offset, end + offset
            if inner:
                todo.append((part[inner[0] : inner[1]], offset + inner[0]))


def _pairs_of(text: str) -> Iterator[tuple[str, str, int, int, tuple[int, int] | None]]:
    """The pairs of one text, and where the inside of a quoted literal that may hold others lies."""
    known: dict[str, tuple[str, int, int]] = {}
    here = bare_end = 0
    while m := _PAIR.search(text, here):
        name, at = m[m.lastgroup if m.lastgroup != "op" else "plain"], m.end()
        here = at
        if block := _BLOCK.match(text, at):
            if found := _block(text, text.rfind("\n", 0, m.start()) + 1, block.end()):
                yield name, *found, None
            continue
        opening = _OPENING.match(text, at)
        parts, pos = [], opening.end() if opening else at
        begin = pos
        prefix = _PREFIX.match(text, pos)
        pos = prefix.end() if prefix else pos
        while step := _CONCAT.match(text, pos):
            parts.append(step[1])
            pos = step.end()
        lit = _LITERAL.match(text, pos)
        kind = lit.lastgroup if lit else "bare"
        if lit:
            end = here = lit.end()
        else:
            if pos >= bare_end:  # a bare word's end is looked for once, however many names are in it
                bare_end = (word := _BARE.match(text, pos)) and word.end() or pos
            end = bare_end
            if end == pos:
                continue
            here = pos
            if end - pos > LONG_BARE and not _NAME_HINT.search(name):
                continue
        if opening and not _ENDING.match(text, end):
            continue
        whole, inner = text[pos:end], None
        if parts:
            values = []
            for p in [*parts, whole]:
                values.append(p[1:-1] if p[0] in "\"'" else known.get(p, ("", 0, 0))[0] if _NAME.match(p) else p)
            found = ("".join(values), begin, end)
        elif kind != "bare":
            body = lit[kind].strip() if kind in ("t1", "t2") else lit[kind]
            start = lit.start(kind) + lit[kind].index(body)
            found = (body, start, start + len(body))
            embeds = [e for e in _EMBEDDED.finditer(body) if (e[1] or e[2]) in known] if "{" in body or "$" in body else []
            if embeds:
                found = (_EMBEDDED.sub(lambda e: known[e[1] or e[2]][0] if (e[1] or e[2]) in known else e[0], body), start, start + len(body))
        elif whole in known:
            found = known[whole]
        elif text.startswith("(", end) or _READS_AS_NAME.match(whole.rstrip(".")):
            continue
        else:
            bare = whole.rstrip(".")
            found = (bare, pos, pos + len(bare))
        if m["op"] == "+=" and name in known:
            found = (known[name][0] + found[0], *found[1:])
        known[name] = found
        if kind != "bare" and _NAME_HINT.search(lit[kind]):
            inner = lit.span(kind)
        yield name, *found, inner


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """start, end, kind of each span in code points, by start, then kind as listed in KINDS."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    out = []
    if _HINT.search(raw):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_long_hex(raw):
        out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    base = {(s, e) for s, e, _ in out}
    if _NAME_HINT.search(text) and any(c in text for c in ("=", ":", "</", "#", "(")):
        named = {(s, e) for name, value, s, e in pairs(text) if _NAME_HINT.search(name) and literal_score(name, value) >= 4}
        if "</" in text or "/>" in text:
            named |= {(s, e) for name, value, s, e in tagged(text) if _NAME_HINT.search(name) and literal_score(name, value) >= 4}
        out += [(s, e, "name") for s, e in named - base]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def has_long_hex(raw: bytes, least: int = 24) -> bool:
    """Whether a run of least lower-case hex digits is there: every window of that length holds each least-th byte."""
    probe = np.frombuffer(raw, np.uint8)[least - 1 :: least]
    for i in np.flatnonzero(_IS_HEX[probe]):
        at = (int(i) + 1) * least - 1
        lo = at
        while lo > 0 and at - lo < least and _IS_HEX[raw[lo - 1]]:
            lo -= 1
        hi = at
        while hi + 1 < len(raw) and hi - lo + 1 < least and _IS_HEX[raw[hi + 1]]:
            hi += 1
        if hi - lo + 1 >= least:
            return True
    return False


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (start, end, kind) in code points (end exclusive): one row per input row, in one pass without a shuffle.

    Null and empty texts have no spans; texts of any length are scanned whole; repeated rows and ids stay; spans of one
    place and several kinds all stay, but for `name` where a base span is the same. Other columns, whatever their names, are
    left out; an empty table gives an empty result.
    """
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(1))
            found = []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                raw = data[a:b].tobytes()
                found.append([{"start": s, "end": e, "kind": k} for s, e, k in scan(raw.decode("utf-8", "replace"), raw)])
            spans = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<start: long, end: long, kind: string>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret span of the text replaced by mark (overlapping spans once); all rows and columns kept.

    Null texts stay null, empty ones empty; repeated rows are treated alike; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s, e, _ in scan(text):
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))
