"""Secret scan: fixed patterns and an assignment-aware lexer for source and configuration text.

The lexer reads name-literal pairs (`name = "..."`, `name: ...`, `"name": "..."`, `name := ...`,
`name => ...`), joins literals that are concatenated, and keeps a table of constants, so that a
literal that reaches a sensitive name by way of another name is found where it stands. A
pair's score is the sensitivity of the name times how much the literal looks like
generated key material (length, character kinds, entropy, no placeholder).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches, texts

KINDS = ("assign", "access", "hex", "literal")
#: The base patterns, fixed: pattern, group that has to have the least length, least length.
BASE = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # A run of fewer than 16 fails whole, so it need not be matched first.
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: Word parts of names and the weight they give, fixed.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.4,
}
#: Parts that make `key` sensitive, fixed.
KEY_OF = {"api", "access", "private", "secret", "auth", "encryption", "signing", "client", "master", "account", "service"}
#: A text without any of these has no sensitive name.
STEMS = ("passw", "pwd", "passphrase", "secret", "token", "key", "credential", "auth", "bearer", "signature", "salt")
#: A value with one of these in it, or with ends like these, is a placeholder.
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|your[_-]|dummy|todo|redacted")
FRAMED = re.compile(r"<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*")
NAME = re.compile(
    r"""(?<![A-Za-z0-9_.\-])(?P<q>["'`]?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?P=q)\]?[\x20\t]*"""
    r"""(?::[\x20\t]*[A-Za-z_][\w.\[\]]*[\x20\t]*(?==[^=]))?(?::=|=>|=(?![=>])|:(?!:))[\x20\t]*"""
)
VALUE = re.compile(r"""(?P<q>["'`])(?P<text>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>[A-Za-z0-9+/_.=~!@%^&\-]+)""")
JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|&)?[\x20\t]*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
THRESHOLD = 0.5
#: A longer value of which no more is different, as its literals repeat, is data and no key.
LONGEST = 4096
#: Characters at the ends of a value that are kept; more than any word of PLACEHOLDER has.
EDGE = 16


def sensitivity(name: str) -> float:
    parts = [x.lower() for x in PART.findall(name)]
    best = max((SENSITIVE.get(x, 0.0) for x in parts), default=0.0)
    if "key" in parts and KEY_OF.intersection(parts):
        best = 1.0
    joined = "".join(parts[-2:])
    return max(best, SENSITIVE.get(joined, 0.0))


class Joined:
    """The value of an assignment: what strength() asks of it, and the values or the place it is made of.

    Numbers and ends of values add up and the values themselves are shared, so a value may be far longer than its text: n joins
    cost n, also where names are joined with themselves.
    """

    def __init__(self, text: str = "", place: tuple[int, int] | None = None):
        self.size, self.counts, self.head, self.tail = len(text), Counter(text), text[:EDGE], text[-EDGE:]
        self.placeholder = bool(PLACEHOLDER.search(text))
        self.place, self.made_of = place, []
        #: The different literals, each once, as long as they have no more than LONGEST characters.
        self.different: set[str] | None = {text} if len(text) <= LONGEST else None
        self.fresh = len(text)

    def add(self, other: Joined) -> None:
        if not other.size:
            return  # an empty one has no place
        self.placeholder = self.placeholder or other.placeholder or bool(PLACEHOLDER.search(self.tail + other.head))
        self.head, self.tail = (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:]
        self.size += other.size
        self.counts.update(other.counts)
        self.made_of.append(other)
        if self.different is not None and other.different is not None:
            self.fresh += sum(len(x) for x in other.different - self.different)
            self.different |= other.different
        if other.different is None or self.fresh > LONGEST:
            self.different = None

    def repeats(self) -> bool:
        return self.size > LONGEST and self.different is not None

    def places(self, walked: set[Joined]) -> Iterator[tuple[int, int]]:
        """The places of the literals, but for those of values in `walked`, to which all that are seen here are added."""
        todo = [self]
        while todo:
            at = todo.pop()
            if at not in walked:
                walked.add(at)
                if at.place:
                    yield at.place
                todo += at.made_of


def strength(literal: str | Joined) -> float:
    """0 to 1: how much a literal, or a value that is joined of some, looks like a generated key."""
    v = Joined(literal) if isinstance(literal, str) else literal
    n, kept = v.size, "".join(v.counts)
    if n < 8 or v.placeholder or FRAMED.fullmatch(v.head + v.tail) or kept in ("x", "X", "xX", "Xx", "*"):
        return 0.0
    if re.search(r"\s", kept) or re.match(r"(?:https?|file|ftp)://|\.{0,2}/", v.head):
        return 0.0
    kinds = sum(bool(re.search(p, kept)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in v.counts.values())
    if kinds == 1 and not kept.isdigit():
        return 0.0  # one word of plain letters
    return min(n, 16) / 16 * min(1.0, entropy / 3.0) * (0.6 + 0.2 * min(2, kinds - 1))


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """kind, start and end of the match, start and end of the secret in it."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text:
            continue
        out += [(kind, *m.span(), *m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def pairs(text: str) -> Iterator[tuple[str, Joined]]:
    """name and joined value, for each assignment of one character or more."""
    known: dict[str, Joined] = {}
    at = 0
    while m := NAME.search(text, at):
        at = m.end()
        value, here, last, found = Joined(), at, -1, False
        while v := VALUE.match(text, here):
            here, found = v.end(), True
            if v["bare"] is not None and v["bare"] in known:
                value.add(known[v["bare"]])
                last = -1
            else:
                kind = "text" if v["bare"] is None else "bare"
                value.add(Joined(v[kind], v.span(kind)))
                last = v.end(kind)
            joint = JOIN.match(text, here)
            if not joint[0].strip() and not (v["q"] and VALUE.match(text, joint.end()) and text[joint.end()] in "\"'"):
                break
            here = joint.end()
        if found:
            known[m["name"]] = value
            # The value may itself be the name of a pair, as in `a: b: c`.
            at = max(at, here) if last == here or text[here - 1 : here] in "\"'`" else at
            if value.size:
                yield m["name"], value


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, int, int, float, str]]:
    """All spans by start, then kind: kind, start, end, start and end of the secret, score, name."""
    found = [(*x, 1.0, "") for x in base_spans(text)]
    low = text.lower()
    if any(s in low for s in STEMS):
        taken = {(a, b) for _, _, _, a, b, _, _ in found}
        seen, walked = set(), set()
        for name, value in pairs(text):
            if (weight := sensitivity(name)) and not value.repeats() and (score := weight * strength(value)) >= threshold:
                for a, b in value.places(walked):
                    if b > a and (a, b) not in taken and (a, b) not in seen and not any(x <= a and b <= y for x, y in taken):
                        seen.add((a, b))
                        found.append(("literal", a, b, a, b, round(score, 4), name))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long,secret_start:long,secret_end:long,score:double,name:string>>"


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (code points, end exclusive) for each row of docs (doc_id, text; others are ignored).

    A null text is empty and has none; repeated rows each get their row, ids may be null, texts are
    read whole whatever their length.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64()), ("secret_end", pa.int64()), ("score", pa.float64()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in item]
        for batch in batches:
            rows = [[dict(zip(names, x, strict=True)) for x in spans(t, threshold)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by a mark (n_chars, where there is one, counts anew).

    Overlapping secrets get one mark. All other columns and all rows, repeated ones too, stay as they are, whatever the columns'
    names; a null text stays null, an empty one empty, and an empty table gives an empty result. Texts are read whole.
    """
    at = docs.columns.index("text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def clean(text: str) -> str:
        out, done = [], 0
        for a, b in sorted((x[3], x[4]) for x in spans(text, threshold)):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x.as_py() is None else clean(x.as_py()) for x in batch.column(at)], pa.string())
            yield batch.set_column(at, f"c{at}", made)

    done = map_batches(numbered, run, numbered.schema).toDF(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
