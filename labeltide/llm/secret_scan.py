"""Operator 9: secrets, by fixed formats and by what it would take to guess a value in a credential context.

Base kinds are regular expressions whose failing matches are dropped.  The
method adds spans of kind ``guess``: values that follow a credential word and a
separator and whose guess cost reaches ``least_cost`` (log10 of guesses).  The
cost is the cheapest segmentation of the value, by dynamic programming, into
dictionary words (also with capitals and common letter substitutions), dates,
repeats, keyboard walks and brute-force spans.

A text is searched only if a linear-time pre-test over the whole Arrow batch
says that some pattern can match in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below 16 characters fail, and runs are maximal, so the length can be asked for at once.
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential word (which may end a longer name), a separator, and a value that ends at a blank, a quote or a bracket.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|login|pin)"""
    r"""["']?(?:[\x20\t]*[:=]{1,2}[\x20\t]*|[\x20\t]+is[\x20\t]+)(?:bearer[\x20\t]+)?["']?([^\s"'<>(){}\[\],;]{6,})""", re.IGNORECASE | re.ASCII)
MAYBE = (r"""(?i)(?:pass|pwd|passwd|password|passphrase|passcode|secret|token|key|auth|authorization|credentials?|bearer|login|pin)["']?(?:[\x20\t]*[:=]|[\x20\t]+is[\x20\t])"""
         r"""|AKIA[A-Z0-9]{14}|(?-i:[0-9a-f]{16})""")
LEAST_COST = 10.0

# Common passwords and words in passwords, most frequent first.
COMMON = """password admin welcome letmein login master dragon monkey shadow sunshine princess football baseball superman batman
iloveyou trustno hello freedom whatever michael jordan hunter killer soccer hockey george charlie andrew michelle love secret
summer winter spring autumn flower cheese computer internet service system server backup guest root user test demo default
changeme example sample access token public private company office home money orange banana cookie pepper ginger silver gold
diamond purple yellow green blue black white red tiger lion eagle falcon wolf bear horse star moon sun sky ocean river mountain
magic power energy music guitar piano samsung google apple windows linux ubuntu docker oracle mysql postgres database prod
production staging dev develop temp null none true false undefined placeholder redacted your my the and for key pass word
january february march april may june july august september october november december monday tuesday wednesday thursday
friday saturday""".split()
# Words that hold the place of a secret, and first names of expressions that fetch one.
PLACEHOLDERS = set("your change changeme replace insert enter example sample dummy placeholder redacted none null undefined here todo xxx xxxx".split())
CODE_ROOTS = set("process os env environ environment settings config conf self this app request req ctx context secrets vault system options args params".split())
# The rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")


def _walks() -> set[tuple[str, str]]:
    """Pairs of neighbouring keys, along a row or between rows."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (xa, ya) in place.items() for b, (xb, yb) in place.items()
            if a != b and abs(ya - yb) <= 1 and abs(xa - xb) <= 1.0}


def _common(value: str, a: int, b: int) -> int:
    """Length of the longest common start of ``value[a:]`` and ``value[b:]``, a < b."""
    done, step, most = 0, 1, len(value) - b
    while done + step <= most and value[a + done:a + done + step] == value[b + done:b + done + step]:
        done, step = done + step, 2 * step
    while step:
        if done + step <= most and value[a + done:a + done + step] == value[b + done:b + done + step]:
            done += step
        step //= 2
    return done


def ranked_words(tokenizer_file: str) -> list[str]:
    """A ranked dictionary from a public tokenizer's JSON vocabulary: its tokens that end a word, in letters, in the order of their merges.

    These are whole words and common endings.  Merges are made in the order of frequency, so a token's place is near its rank.
    The file is a parameter and stays where it is; its licence stands beside it.
    """
    import json

    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ends = [(place, token[:-4]) for token, place in vocabulary.items() if token.endswith("</w>")]
    return [word for _, word in sorted(ends) if len(word) >= 3 and word.isascii() and word.isalpha()]


class GuessCost:
    """log10 of the guesses for a value: the cheapest way to write it as known parts and brute force.

    ``words`` is a ranked dictionary, most frequent first; the common passwords always stand before it.
    """

    def __init__(self, words: list[str] | None = None):
        self.rank = {}
        for r, w in enumerate([*COMMON, *(words or [])], 1):
            if len(w) >= 3:
                self.rank.setdefault(w.lower(), r)
        self.longest = max(map(len, self.rank), default=0)
        self.starts = {w[:3] for w in self.rank}
        self.near = _walks()

    @staticmethod
    def alphabet(part: str) -> int:
        """Size of the smallest usual alphabet that holds ``part``."""
        if re.fullmatch(r"[0-9]+", part):
            return 10
        if re.fullmatch(r"[0-9a-f]+", part):
            return 16
        return max(2, 10 * any(c.isdigit() for c in part) + 26 * any("a" <= c <= "z" for c in part)
                   + 26 * any("A" <= c <= "Z" for c in part) + 33 * any(not (c.isalnum() and c.isascii()) for c in part))

    def stands_for_one(self, value: str) -> bool:
        """Whether the value is no secret but holds its place or names where it comes from."""
        parts = [x for x in re.split(r"[^A-Za-z0-9]+", value.lower()) if x]
        if re.fullmatch(r"[$%{<\[(].*", value) or not parts:
            return True
        if re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\(.*)?", value) and parts[0] in CODE_ROOTS:
            return True
        known = all(p in self.rank or len(p) <= 2 and p.isalpha() or len(set(p)) == 1 for p in parts)
        return known and any(p in PLACEHOLDERS for p in parts)

    def _words(self, value: str, lower: str, add) -> None:
        plain, n = lower.translate(LEET), len(value)
        for form, extra in ((lower, 0.0), (plain, 0.5)):
            if extra and plain == lower:
                break
            for i in range(n - 2):
                if form[i:i + 3] not in self.starts:
                    continue
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    if form[i:j] in self.rank and not (extra and lower[i:j] in self.rank):
                        part = value[i:j]
                        capitals = 0.0 if part == lower[i:j] else 0.3 if part[:1] + lower[i + 1:j] == part or part == part.upper() else 1.0
                        add(i, j, math.log10(self.rank[form[i:j]] + 1) + capitals + extra)

    @staticmethod
    def _stretch(start: int, end: int, least: int, unit_cost: float, unit: int, add) -> None:
        """A repeat may give up signs at either end to a neighbouring part."""
        for i in range(start, end - least + 1):
            add(i, end, unit_cost + math.log10((end - i) // unit + 1))
        for j in range(start + least, end):
            add(start, j, unit_cost + math.log10((j - start) // unit + 1))

    def _repeats(self, value: str, add) -> None:
        n, runs = len(value), []
        for unit in range(1, min(8, n // 2) + 1):  # repeats of a short unit
            i = 0
            while i + 2 * unit <= n:
                end = i + unit
                while end < n and value[end] == value[end - unit]:
                    end += 1
                if end - i >= max(3, 2 * unit):
                    self._stretch(i, end, max(3, 2 * unit), unit * math.log10(self.alphabet(value[i:i + unit])), unit, add)
                    runs.append((unit, i, end))
                    i = end - unit + 1
                else:
                    i += 1
        back = value[::-1]
        for unit in range(9, n // 2 + 1):  # repeats of a longer one: each holds a multiple of the unit
            # A stretch that repeats a part of the unit already has a cheaper way to be written.
            runs = [run for run in runs if run[2] - run[1] > unit]
            held = [(start, end) for part, start, end in runs if unit % part == 0]
            end, i = 0, 0
            while i < n - unit:
                inside = next((e for s, e in held if s <= i and i + unit < e), None) if held else None
                if inside is not None:
                    i = max(i + unit, (inside - unit) // unit * unit)
                    continue
                if i + unit >= end and value[i] == value[i + unit]:
                    start, end = i - _common(back, n - i - unit, n - i), i + unit + _common(value, i, i + unit)
                    if end - start >= 2 * unit:
                        self._stretch(start, end, 2 * unit, unit * math.log10(self.alphabet(value[start:start + unit])), unit, add)
                        runs.append((unit, start, end))
                        held.append((start, end))
                i += unit

    def _known(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """For each end, (start, cost) of the known parts that end there."""
        lower, n = value.lower(), len(value)
        out: dict[int, list[tuple[int, float]]] = {}

        def add(start: int, end: int, cost: float) -> None:
            out.setdefault(end, []).append((start, cost))

        self._words(value, lower, add)
        for m in re.finditer(r"(?=((?:19|20)\d\d)(?!\d)|((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))|((?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d))", value):
            for k in (1, 2, 3):
                if m.group(k):
                    add(m.start(k), m.end(k), 2.1 if k == 1 else 4.6)
        self._repeats(value, add)
        for step in ((lambda a, b: (a, b) in self.near), (lambda a, b: ord(b) - ord(a) == 1), (lambda a, b: ord(b) - ord(a) == -1)):
            begin = 0  # walks and sequences: each stretch once, less signs at either end
            for end in range(1, n + 1):
                if end == n or not step(lower[end - 1], lower[end]):
                    for i in range(begin, end - 2):
                        add(i, end, 1.7 + 0.6 * math.log10(end - i))
                    for j in range(begin + 3, end):
                        add(begin, j, 1.7 + 0.6 * math.log10(j - begin))
                    begin = end
        return out

    def __call__(self, value: str) -> float:
        """At most the cost of brute force over the whole value; each further part costs its order among the parts."""
        n = len(value)
        if not n or self.stands_for_one(value):
            return 0.0
        per_sign = math.log10(self.alphabet(value))
        known = self._known(value)
        best = [0.0] + [math.inf] * n
        for end in range(1, n + 1):
            best[end] = best[end - 1] + per_sign
            for start, cost in known.get(end, ()):
                best[end] = min(best[end], best[start] + cost + 0.3)
        return best[n]


def find_secrets(text: str, cost: GuessCost, least_cost: float = LEAST_COST) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span in code points, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".:!?")
        if len(value) >= 6 and cost(value) >= least_cost:
            found.append((m.start(1), m.start(1) + len(value), "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _spans(found: list[tuple[int, int, str]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found if k in kinds)


def _scanner(words: list[str] | None, least_cost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, nothing = GuessCost(words), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = {k: [0] * n for k in BASE_KINDS}
            digests, spans = [nothing] * n, [""] * n
            maybe = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), MAYBE), False))
            for i in maybe.to_pylist():
                found = find_secrets(batch.column(1)[i].as_py(), cost, least_cost)
                for k in BASE_KINDS:
                    counts[k][i] = sum(x[2] == k for x in found)
                digests[i] = hashlib.sha256(_spans(found, BASE_KINDS).encode()).hexdigest()
                spans[i] = _spans(found, KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])
    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None,
                 least_cost: float = LEAST_COST) -> DataFrame:
    """Per row: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, comma-joined).

    Null and empty texts have no spans.  Rows are independent, so repeated rows and ids give
    repeated results, and other columns are ignored.  ``words``: a ranked dictionary, most
    frequent first (:func:`ranked_words`), beside the built-in common passwords.  An empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scanner(words, least_cost), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def _redactor(words: list[str] | None, least_cost: float, mark: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(batch.column(at), MAYBE), False)).to_pylist():
                out, done = [], 0
                for a, b, _ in find_secrets(texts[i], cost, least_cost):
                    if b > done:
                        out += [texts[i][done:max(a, done)], mark if a >= done else ""]
                        done = b
                texts[i] = "".join(out) + texts[i][done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", words: list[str] | None = None,
                   least_cost: float = LEAST_COST, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans become one.  Other columns stay, whatever their names."""
    return docs.mapInArrow(_redactor(words, least_cost, mark, docs.columns.index(text_col)), docs.schema)
