"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are lower-cased and their white space is made single spaces, so notices that wrap over lines are found; one
automaton holds all phrases and the tag.  Of overlapping notices the leftmost longest counts, at word boundaries only.
The expression after a tag (to the end of its line) is parsed with WITH over AND over OR; several tags and notices of
one document must all be acceptable."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = "spdx-license-identifier:"
NOTICES = {
    "apache license, version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache-2.0 license": "Apache-2.0",
    "mit license": "MIT", "the mit licence": "MIT", "permission is hereby granted, free of charge": "MIT",
    "isc license": "ISC", "zlib license": "Zlib", "boost software license": "BSL-1.0", "bsd 2-clause": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause", "redistribution and use in source and binary forms": "BSD-3-Clause",
    "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "eclipse public license": "EPL-2.0",
    "gnu general public license, version 3": "GPL-3.0", "gnu general public license, version 2": "GPL-2.0", "gnu general public license": "GPL",
    "gnu lesser general public license": "LGPL", "gnu affero general public license": "AGPL-3.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by 4.0": "CC-BY-4.0", "cc0 1.0": "CC0-1.0",
    "creative commons attribution 4.0": "CC-BY-4.0", "dedicated to the public domain": "CC0-1.0", "the unlicense": "Unlicense", "all rights reserved": "LicenseRef-All-Rights-Reserved",
}
ALLOWED = frozenset("Apache-2.0 MIT ISC Zlib BSL-1.0 BSD-2-Clause BSD-3-Clause 0BSD CC-BY-4.0 CC0-1.0 Unlicense MPL-2.0 Python-2.0 MIT-0".split())
ALLOWED_WITH = frozenset({("GPL-2.0-only", "Classpath-exception-2.0"), ("GPL-2.0-or-later", "Classpath-exception-2.0"), ("GPL-3.0-or-later", "GCC-exception-3.1")})
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.\-:]+\+?)")
_LINE = re.compile(r"(?<![^\W_])" + re.escape(TAG) + r"[ \t]*([^\r\n]*)", re.I)  # at a word boundary, as the automaton has it
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


class Invalid(ValueError):
    """Not a licence expression."""


def postfix(text: str) -> list[str]:
    """Tokens of an expression in postfix order (shunting-yard)."""
    text = re.sub(r"(\*/|-->|#\}|\*\))\s*$", "", text.strip()).strip()
    at, out, ops, operand = 0, [], [], True
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Invalid(text)
        at, t = m.end(), m[1]
        if t == "(":
            if not operand:
                raise Invalid(text)
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops or operand:
                raise Invalid(text)
            ops.pop()
        elif t.upper() in _RANK:
            if operand:
                raise Invalid(text)
            t = t.upper()
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
        else:
            if not operand:
                raise Invalid(text)
            out.append(t)
            operand = False
        while at < len(text) and text[at].isspace():
            at += 1
    if operand or "(" in ops:
        raise Invalid(text)
    return out + ops[::-1]


def evaluate(text: str, allowed: frozenset = ALLOWED, allowed_with: frozenset = ALLOWED_WITH) -> tuple[bool, list[str]]:
    """Whether an expression can be satisfied with allowed licences, and the licences it names.  A licence with an
    exception is acceptable where the licence is (an exception only adds permissions) or the pair is listed."""
    fold, names = {x.lower(): x for x in allowed}, []
    stack: list[tuple[bool, str | None]] = []
    for t in postfix(text):
        if t not in _RANK:
            plain = t.rstrip("+")
            names.append(fold.get(plain.lower(), plain))
            stack.append((plain.lower() in fold, t))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "WITH":
            if left is None or right is None:
                raise Invalid(text)
            names.pop()
            stack.append((a or (left, right) in allowed_with, None))
        else:
            stack.append((a and b if t == "AND" else a or b, None))
    return stack[0][0], names


def automaton(notices: dict[str, str] = NOTICES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, name in notices.items():
        a.add_word(phrase, (len(phrase), name))
    a.add_word(TAG, (len(TAG), None))
    a.make_automaton()
    return a


def scan(text: str | None, a: ahocorasick.Automaton, allowed: frozenset = ALLOWED, allowed_with: frozenset = ALLOWED_WITH) -> tuple[int, int, str, str, str, int]:
    """(tags, notices, licences, expression, verdict, allowed) of one text."""
    if not text:
        return 0, 0, "", "", "none", 1
    flat = " ".join(text.lower().split())
    hits, tagged = [], False
    for end, (size, name) in a.iter(flat):
        begin = end + 1 - size
        if (begin and flat[begin - 1].isalnum()) or (name and end + 1 < len(flat) and flat[end + 1].isalnum()):
            continue
        if name is None:
            tagged = True
        else:
            hits.append((begin, -end, name))
    if not hits and not tagged:
        return 0, 0, "", "", "none", 1
    terms = [m[1].strip() for m in _LINE.finditer(text)] if tagged else []
    names, ok, bad, edge, notices = [], True, False, -1, []
    for t in terms:
        try:
            good, found = evaluate(t, allowed, allowed_with)
            ok &= good
            names += found
        except Invalid:
            bad = True
    for begin, end, name in sorted(hits):
        if begin > edge:
            edge = -end
            notices.append(name)
            ok &= name in allowed
    names += notices
    clauses = list(dict.fromkeys([f"({t})" if " " in t else t for t in terms] + notices))
    verdict = "invalid" if bad else "allowed" if ok else "restricted"
    return len(terms), len(notices), ",".join(sorted(set(names))), " AND ".join(clauses), verdict, int(ok and not bad)


def _scan(notices: dict[str, str], allowed: frozenset, allowed_with: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(notices)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
        for b in batches:
            texts = b.column(1)
            rows = [scan(texts[k].as_py(), a, allowed, allowed_with) for k in range(b.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", "tags", "notices", "licences", "expression", "verdict", "allowed"])

    return run


def scan_licences(docs: DataFrame, notices: dict[str, str] | None = None, allowed: Iterable[str] = ALLOWED, allowed_with: Iterable[tuple[str, str]] = ALLOWED_WITH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: tags and notices found (their numbers), the licences they name (sorted, joined
    by commas), the clauses joined by AND, the verdict (none, allowed, restricted, invalid) and allowed (1 or 0).

    ``notices`` gives phrases (in lower case, single spaces) and the licence each names, ``allowed`` the acceptable licences
    and ``allowed_with`` further pairs of a licence and its exception.

    Defined cases: a null or empty text has verdict none and is allowed; an expression that doesn't parse makes the
    document invalid and not allowed; ids may be null or repeated, and of any type; other columns are ignored; an empty
    table gives no rows.  Whole texts are scanned, whatever their length, in one pass without a shuffle."""
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(_scan(NOTICES if notices is None else notices, frozenset(allowed), frozenset(allowed_with)), f"doc_id {kind}, tags int, notices int, licences string, expression string, verdict string, allowed int")


def op3(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
