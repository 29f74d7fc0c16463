"""Operator 4: secret scans by assignment-aware lexing.

Three base patterns are matched first, leftmost and without overlap, each on its own; matches that
are too short are dropped. Then texts that name something sensitive are lexed: statements of the
common source and configuration languages become pairs of a name and its literals, of any length and also
over several lines (triple quotes, quoted armoured keys, here-documents, block scalars). Declarations with a type,
fallbacks behind a question mark, ``or`` or a lookup, lists and maps of literals, literals next to each other, assignments
of several names, setters and calls with a name and a value are read as well. Names that are
given a literal are constants, and where a constant or a concatenation is assigned on, its literals
go along, also if the constant is defined further down. A literal is scored by the names it reaches, word by word, and by its own shape; of those that pass, the parts
that no base span covers are added as spans of kind ``literal``. Redaction masks base spans and whole literals.

Null and empty texts have no spans. Spans are code points, end exclusive. Repeated rows are scanned
each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import ship, tidy

# Fixed patterns of the base scan, and the least length of what they find.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")
HINTS = ("passw", "secret", "token", "api")  # every base assignment holds one of them in lower case

# Words that make a name sensitive alone, pairs of words that do, words before ``key`` that say it is none of a lock, and last
# words that say the name holds something about a secret.
ALONE = frozenset("password passwd passwort pwd pass pw passphrase passcode secret token apikey credential cred".split())
PAIRS = frozenset(
    "access key,api key,account key,auth key,client key,deploy key,encryption key,license key,master key,private key,secret key,session key,"
    "shared key,signing key,ssh key,storage key,webhook key,auth header".split(",")
)
PLAIN_KEYS = frozenset(
    "alt arrow cache column composite config ctrl cursor dict enter escape event file foreign function group hash home hot i18n index json "
    "lookup main map message natural object order page partition primary public registry route row search shift sort sorting tab translation unique".split()
)
HARMLESS = frozenset(
    "count url uri path file filename name hint id len length max min type field label policy prompt regex pattern "
    "ttl expiry expire timeout size limit budget vocab index ref env var used usage left remaining total rate status state version".split()
)
SETTERS = frozenset("set with put add define store assign update use".split())
LOOKUPS = frozenset("getenv get env environ getordefault getproperty getstring fetch setdefault config var lookup optional".split())
WRAPS = frozenset("str string bytes secretstr secret b64decode encode decode strip trim new sensitive".split())
PLACEHOLDER = re.compile(r"(?i)^([.~]*/[\w./\-]+|\d{4}-\d\d-\d\d[t\d:.z+\- ]*|[a-z][a-z0-9+.\-]*://[^:@\s]*|x+|\*+|\.+|<.*>|\$\{?.*\}?|%.*%|your.*|my_?.*here|change_?me|example.*|placeholder|none|null|true|false|todo|test|dummy|redacted|\[.*\])$")
SENSITIVE = re.compile(r"(?i)pass|pwd|secret|token|cred|key[\"'\])]{0,2}[ \t]*+[:=,]|key\w{0,8}[ \t]*+[(:=]|auth")
PAIR = (
    r"""[\d.\-]*+(?P<name>[^\W\d][\w.\-]*+)(?:\[\w*+\])?["'`\]>]{0,2}[ \t]*+"""
    r"""(?P<op>:=|=>|=(?![=>])|:(?![:/])|(?<=>)(?=[^<\s]))[ \t]*+"""
)
NAMED, NEXT = re.compile(r"(?<![\w.\-])" + PAIR), re.compile(PAIR)
# In triple quotes, armoured keys over several lines, and strings of one line; the last group is the value.
STRING = re.compile(
    r"""[bfruBFRU]{0,2}(?:\"{3}((?:[^"\\]++|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3}|(["'`])(-----BEGIN\ [^"'`\\]*+)\3|"""
    r""""((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)"""
)
HERE = re.compile(r"""(?:["']?\$\([ \t]*+cat[ \t]++)?<<<?[~-]?[ \t]*+(["']?)(?P<tag>[^\W\d]\w*+)\1[^\n]*+\n""")
BLOCK = re.compile(r"""(?:[!&][^\s]++[ \t]++)?[|>][-+\d]{0,2}[ \t]*+(?:\#[^\n]*+)?\r?\n""")
BEFORE_KEY = re.compile(r"""[ ]*+(?:[-?][ ]++)*+["']?\Z""")
FIRST_WORDS = re.compile(r"(?m)^[ \t]*+(\w++)")
CONSTANT = re.compile(r"[A-Z]+(?:_[A-Z0-9]+)+\Z")  # the name of a setting, not its value
ARMOUR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]++-----")
REFERENCE = re.compile(r"\$?\{?\{?[ ]?(?P<name>[^\W\d][\w.]{0,127})[ ]?\}{0,2}")
BARE = re.compile(r"""[^\s;,{}()\[\]"'`<>]+""")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\||&)[ \t]*")
# The type of a declaration, between a colon and the sign of assignment, and one between a name and that sign.
TYPED = re.compile(r"&?(?:'\w++[ \t]++)?[^\W\d][\w.:]*+(?:(?:[<\[][\w ,.|&?*]*+)++[>\]]++)?+\??[ \t]*+=(?![=>])[ \t]*+")
DECLARED = re.compile(r"(?:var|const)[ \t]++([^\W\d]\w*+)[ \t]++[*\[\]]*+\Z")
CALL = re.compile(r"""(?P<fn>[^\W\d][\w.]*+)[ \t]*+\(\s*+(?=["'`])""")
COMMA = re.compile(r"\s*+,\s*+")
SEVERAL = re.compile(r"""(?<![\w.,])(?P<names>[^\W\d]\w*+(?:[ \t]*+,[ \t]*+[^\W\d]\w*+)++)[ \t]*+:?=(?!=)[ \t]*+(?=["'`])""")
BEARER = re.compile(r"""(?i)authori[sz]ation["'\]]{0,2}[ \t]*+[:=,][ \t]*+["']?(?:bearer|basic|token)[ \t]++([\w.~+/=\-]{8,}+)""")
TOKEN = re.compile(r"""(?P<word>[^\W\d][\w.]*+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comment>\#|//)|\|\||\?\?|=>|[^\s]""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds by their place in ``KINDS``."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if may_hold_hex(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


IS_HEX = np.zeros(256, np.uint8)
IS_HEX[list(b"0123456789abcdef")] = 1
EIGHT = 0x0101010101010101


def may_hold_hex(text: str) -> bool:
    """Whether some aligned eight bytes are all hex digits, as in any run of fifteen or more."""
    raw = IS_HEX[np.frombuffer(text.encode(), np.uint8)]
    return bool((raw[: len(raw) & ~7].view(np.uint64) == EIGHT).any())


def words_of(name: str) -> list[str]:
    """The words of a name in lower case, plurals as singulars."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] not in "su" else w for w in words]


def name_score(name: str) -> float:
    """0 for harmless names, 1 for names of secrets, 0.5 for keys of an unknown kind."""
    words = [w for w in words_of(name) if not w.isdigit()]
    if not words or words[-1] in HARMLESS or words[0] in ("max", "min", "num", "n", "use", "has", "is"):
        return 0.0
    if any(w in ALONE for w in words) or any(f"{a} {b}" in PAIRS for a, b in zip(words, words[1:], strict=False)):
        return 1.0
    return 0.5 if len(words) > 1 and words[-1] == "key" and words[-2] not in PLAIN_KEYS else 0.0


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, from its length, characters and entropy."""
    value = ARMOUR.sub("", value)
    if "\n" in value:  # lines are wrapped, not words of a text
        value = "".join(map(str.strip, value.split("\n")))
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    score = 0.2 * quoted + 0.15 * kinds + 0.1 * min(entropy, 4) + 0.1 * (len(value) >= 12)
    return score - 0.5 * (" " in value) - 0.4 * (not quoted and not re.search(r"\d", value))


def block_end(text: str, at: int, end: int, indent: int) -> int:
    """The end of the lines from ``at`` that are blank or indented by more than ``indent``, without blank ones behind."""
    last = at
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        if not text[at : min(at + indent + 1, stop)].isspace():
            if stop > at:
                break
        elif not text[at:stop].isspace():
            last = stop
        at = stop + 1
    return last


class Bodies:
    """Values over several lines: here-documents and block scalars."""

    def __init__(self, text: str):
        self.text = text
        self.lines: dict[str, list[int]] | None = None  # where lines begin, by their first word

    def find(self, name_at: int, op: str, at: int, end: int) -> tuple[int, int, int] | None:
        """Start and end of the body of a value at ``at``, and where the statement ends."""
        if m := HERE.match(self.text, at, end):
            if self.lines is None:
                self.lines = {}
                for w in FIRST_WORDS.finditer(self.text):
                    self.lines.setdefault(w[1], []).append(w.start())
            ends = self.lines.get(m["tag"], [])
            i = bisect_left(ends, m.end())
            if i < len(ends) and ends[i] < end:
                return m.end(), max(m.end(), ends[i] - 1), self.text.index(m["tag"], ends[i]) + len(m["tag"])
        elif op == ":" and (m := BLOCK.match(self.text, at, end)):
            line = self.text.rfind("\n", 0, name_at) + 1
            if before := BEFORE_KEY.match(self.text, line, name_at):
                stop = block_end(self.text, m.end(), end, len(before[0].rstrip("\"'")))
                return (m.end(), stop, stop) if stop > m.end() else None
        return None


Value = list[tuple[int, int, bool]]
LONG_NAME = 600  # characters looked at for a keyword and a name in front of a type
MOST_AROUND = 5  # expressions of sensitive names that are read within each other; keeps broken brackets linear


def pairs(text: str) -> list[tuple[str, Value]]:
    """Assignments as a name and the literals (start, end, quoted) its value is made of, constants resolved.

    Values over several lines are literals and are lexed inside as well.
    """
    constants: dict[str, Value] = {}
    later: dict[str, list[str]] = {}  # names that were given a name without a literal yet
    around: list[int] = []  # where the expressions of names around end
    out = []
    bodies = Bodies(text)
    regions = [(0, len(text))]
    while regions:
        at, end = regions.pop()
        while m := NEXT.match(text, at, end) or NAMED.search(text, at, end):
            name, here, value, inner = m["name"], m.end(), [], []
            body = bodies.find(m.start("name"), m["op"], here, end)
            if body:
                value.append((*body[:2], True))
                inner.append(body[:2])
                here = body[2]
            while not body:
                if s := STRING.match(text, here, end):
                    value.append((*s.span(s.lastindex), True))
                    here = s.end()
                    if s.lastindex < 3:
                        inner.append(s.span(s.lastindex))
                elif (r := REFERENCE.match(text, here, end)) and r["name"] in constants:
                    value += constants[r["name"]]
                    here = r.end()
                elif not value and (b := BARE.match(text, here, end)):
                    stop = b.start() + len(b[0].rstrip(".,:"))
                    value.append((b.start(), max(stop, b.start()), False))
                    here = b.end()
                j = JOIN.match(text, here, end) if value and value[-1][2] else None
                if not j:
                    break
                here = j.end()
            if m["op"] == "=" and (d := DECLARED.search(text, max(at, m.start("name") - LONG_NAME), m.start("name"))):
                name = d[1]  # the word before the sign was its type
            quoted = bool(value) and value[0][2]
            if not quoted:
                around = [e for e in around if e > here]
                if len(around) < MOST_AROUND and name_score(name):  # further in, the names around have the literals
                    groups, stop = behind(text, m.end(), end, m["op"])
                    out += [(name, group) for group in groups]
                    around.append(stop)
                if (r := REFERENCE.match(text, m.end(), end)) and r["name"] != name:
                    later.setdefault(r["name"], []).append(name)
            if value:
                out.append((name, value))
                if quoted or value[0][0] != m.end():
                    constants[name] = value
            # a bare value may itself be a name that is assigned, as in a = b = "c"
            at = here if value and value[-1][2] else max(m.end(), m.start() + 1)
            if inner:
                regions += [(at, end), *inner[:0:-1]]
                at, end = inner[0]
    known = [n for n in later if n in constants]
    while known:  # constants defined after their use, on and on
        source = known.pop()
        for name in later.pop(source, ()):
            out.append((name, constants[source]))
            if name not in constants:
                constants[name] = constants[source]
                if name in later:
                    known.append(name)
    return out


def behind(text: str, at: int, end: int, op: str) -> tuple[list[Value], int]:
    """The literals that the expression at ``at`` may give, in groups of adjoining ones, and its end: all but names and prompts in calls.

    The expression ends with its line, unless a bracket is open.
    """
    if op == ":" and (t := TYPED.match(text, at, end)):
        at = t.end()
    open_: list[tuple[str, str, int]] = []  # bracket, word before it, commas so far
    out: list[Value] = []
    last, last_end, asked = "", at, False
    while at < end:
        line = text.find("\n", at, end) if not open_ else -1
        while at < end and text[at].isspace() and at != line:
            at += 1
        if at >= end or at == line:
            break
        if s := STRING.match(text, at, end):
            span = (*s.span(s.lastindex), True)
            at = s.end()
            after = text[at : at + 80].lstrip()
            key = bool(open_) and open_[-1][0] == "{" and after[:1] == ":" or after[:2] == "=>"
            if open_ and open_[-1][1]:
                word, n = open_[-1][1].lower().rsplit(".", 1)[-1], open_[-1][2]
                fits = open_[-1][0] == "(" and (word in LOOKUPS and n > 0 or word in WRAPS)
            else:
                fits = bool(open_) or last in ("", "'", "?", "||", "??", "or", "else", "+", ".") or asked and last == ":"
            if fits and not key:
                if last in ("'", "+", ".") and out and out[-1]:
                    out[-1].append(span)
                else:
                    out.append([span])
            last, last_end = "'", at
            continue
        m = TOKEN.match(text, at, end)
        if m["comment"] or m[0] == ";":
            break
        if m["open"]:
            word = last if m[0] != "{" and last_end == at and (last[:1].isalpha() or last[:1] in "_'])") else ""
            open_.append((m[0], word, 0))
            last = "("
        elif m["close"]:
            if not open_:
                break
            open_.pop()
            last = ")"
        else:
            if m[0] == "," and not open_:
                break
            if m[0] == "," and open_:
                open_[-1] = (*open_[-1][:2], open_[-1][2] + 1)
            asked = asked or m[0] == "?"
            last = m["word"] or m[0]
        at = last_end = m.end()
    return out, at


def calls(text: str) -> list[tuple[str, Value]]:
    """Names and literals of setters, of calls with a name and a value, and of assignments to several names at once."""
    out = []
    for m in CALL.finditer(text):
        own, at = [], m.end()
        while s := STRING.match(text, at):
            own.append(s.span(s.lastindex))
            c = COMMA.match(text, s.end())
            at = c.end() if c else len(text)
        if len(own) == 1:
            words = re.split(r"(?<=[a-z])(?=[A-Z])|[_.]", m["fn"])
            setter = next((i for i, w in enumerate(words) if w.lower() in SETTERS), None)
            if setter is not None and setter + 1 < len(words):
                out.append(("_".join(words[setter + 1 :]), [(*own[0], True)]))
        elif len(own) > 1 and own[0][1] - own[0][0] <= 64:
            out.append((text[slice(*own[0])], [(*own[1], True)]))
    for m in SEVERAL.finditer(text):
        at = m.end()
        for name in m["names"].split(","):
            s = STRING.match(text, at)
            if not s:
                break
            out.append((name.strip(), [(*s.span(s.lastindex), True)]))
            c = COMMA.match(text, s.end())
            at = c.end() if c else len(text)
    return out


def literals(text: str) -> set[tuple[int, int]]:
    """Literals that reach a sensitive name and look like secrets, in full."""
    found = set()
    if SENSITIVE.search(text):
        for name, value in (*pairs(text), *calls(text)):
            certain = name_score(name)
            if certain:
                whole = "".join(text[a:b] for a, b, _ in value)
                if literal_score(whole, all(q for _, _, q in value)) >= (0.8 if certain == 1 else 1.05) and not CONSTANT.match(whole):
                    found.update((a, b) for a, b, _ in value if b > a)
        found.update(m.span(1) for m in BEARER.finditer(text))
    return found


def literal_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of ``literals`` outside the sorted spans ``taken``."""
    starts, ends = [], []  # of the spans together
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = set()
    for a, b in literals(text):
        for i in range(bisect_right(ends, a), bisect_left(starts, b)):
            if a < starts[i]:
                out.add((a, 3, starts[i]))
            a = ends[i]
        if a < b:
            out.add((a, 3, b))
    return sorted(out)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + literal_spans(text, base))


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text) and spans (all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = scan(text)
                counts.append([sum(k == kind for _, kind, _ in base) for k in range(3)])
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(every))
            numbers = np.array(counts, np.int64).reshape(-1, 3)
            arrays = [batch.column("doc_id"), *[pa.array(numbers[:, k]) for k in range(3)], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """``text`` with every secret replaced by ``mark``; of an assignment the name stays."""
    if not text:
        return text
    cuts = [(ASSIGN.match(text, a).start(1) if kind == 0 else a, b) for a, kind, b in base_spans(text)]
    out, at = [], 0
    for a, b in sorted([*cuts, *literals(text)]):
        if a >= at:  # a cut that overlaps the one before shares its mark
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the secrets in the text replaced; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text)
            made = pa.array([redact_text(t, mark) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if j == i else c for j, c in enumerate(batch.columns)], names)

    ship(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(docs.columns, names, strict=True))
    done = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).mapInArrow(tidy(run), kinds)
    return done.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
