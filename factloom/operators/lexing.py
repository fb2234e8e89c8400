"""What is code in a text, and which blocks hold it: comments and strings as intervals, blocks as a tree.

``SYNTAX`` says for each language what opens and closes a comment or a string; one automaton reads them all, from opener to
opener, so text inside a comment opens no string and the other way round.  Expressions inside template literals are code.
``stretches`` gives the masked intervals, ``blocks`` the tree of brackets, ``do ... end`` pairs or indented suites around
the code.  Both work on one file at a time inside Arrow batches; ``lexical_masks`` and ``block_tree`` give them as tables.

An opener that is never closed runs to the end of its line if it may not run over lines, else to the end of the text; a
block that is never closed ends with the text, and a closer without an opener closes nothing.  Null contents and languages
without a syntax give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import arrow_ready


class Quote(NamedTuple):
    opener: str  # a pattern
    closer: str  # a pattern
    kind: str = "string"
    lines: bool = False  # may run over the ends of lines
    escape: str = r"\\[\s\S]"  # what closes nothing; "" if nothing is escaped


class Syntax(NamedTuple):
    quotes: tuple[Quote, ...]
    blocks: str = "braces"  # or: words, indents, none
    regex: bool = False  # a slash may open a pattern
    templates: bool = False
    within: str = ""  # a pattern with a group: only there is code of the language
    nested: bool = False  # block comments hold block comments
    heredocs: str = ""  # a pattern whose group ``word`` ends the text below its line


_HASH, _SLASHES, _DASHES = Quote("#", r"$", "comment"), Quote("//", r"$", "comment"), Quote("--", r"$", "comment")
_BLOCK = Quote(r"/\*", r"\*/", "comment", True, "")
_HTML = Quote("<!--", "-->", "comment", True, "")
_DOUBLE, _SINGLE = Quote('"', '"'), Quote("'", "'")
_TRIPLE = Quote('"""', '"""', "string", True)
_CHAR = Quote(r"'(?=\\[^\n]{1,10}?'|[^'\\\n]')", "'")
_C = (_SLASHES, _BLOCK, _DOUBLE)
#: language -> syntax
SYNTAX = {
    "python": Syntax((_HASH, Quote(r"(?i:\b[rbuf]{1,2})?\"\"\"", '"""', "string", True), Quote(r"(?i:\b[rbuf]{1,2})?'''", "'''", "string", True), _DOUBLE, _SINGLE), "indents"),
    "javascript": Syntax((_SLASHES, _BLOCK, _DOUBLE, _SINGLE), regex=True, templates=True),
    "vue": Syntax((_SLASHES, _BLOCK, _DOUBLE, _SINGLE), regex=True, templates=True, within=r"<script\b[^>]*>(.*?)(?:</script>|\Z)"),
    "java": Syntax((*_C[:2], _TRIPLE, _DOUBLE, _CHAR)),
    "kotlin": Syntax((*_C[:2], Quote('"""', '"""', "string", True, ""), _DOUBLE, _CHAR), nested=True),
    "groovy": Syntax((*_C[:2], _TRIPLE, Quote("'''", "'''", "string", True), _DOUBLE, _SINGLE)),
    "swift": Syntax((*_C[:2], _TRIPLE, _DOUBLE), nested=True),
    "dart": Syntax((*_C[:2], _TRIPLE, Quote("'''", "'''", "string", True), _DOUBLE, _SINGLE), nested=True),
    "csharp": Syntax((*_C[:2], _TRIPLE, Quote(r'\$?@\$?"', '"', "string", True, '""'), _DOUBLE, _CHAR)),
    "go": Syntax((*_C, Quote("`", "`", "string", True, ""), _CHAR)),
    "rust": Syntax((*_C[:2], Quote(r'\bb?r(?P<hashes>#*)"', r'"(?P=hashes)', "string", True, ""), Quote('"', '"', "string", True), _CHAR), nested=True),
    "php": Syntax((Quote(r"#(?!\[)", r"$|(?=\?>)", "comment"), _SLASHES, _BLOCK, Quote('"', '"', "string", True), Quote("'", "'", "string", True)), within=r"<\?(?:php\b|=)?(.*?)(?:\?>|\Z)", heredocs=r"<<<[ \t]*[\"']?(?P<word>[A-Za-z_]\w*)[\"']?"),
    "ruby": Syntax((_HASH, Quote(r"^=begin\b", r"^=end\b[^\n]*", "comment", True, ""), Quote('"', '"', "string", True), Quote("'", "'", "string", True)), "words", regex=True, heredocs=r"<<[~-]?[\"'`]?(?P<word>[A-Z_]\w*)[\"'`]?"),
    "elixir": Syntax((_HASH, _TRIPLE, Quote("'''", "'''", "string", True), Quote('"', '"', "string", True), Quote(r"'(?=[^'\n]*')", "'")), "words"),
    "clojure": Syntax((Quote(";", r"$", "comment"), Quote('"', '"', "string", True)), "braces"),
    "sql": Syntax((_DASHES, _BLOCK, Quote("'", "'", "string", True, "''")), "none"),
    "shell": Syntax((Quote(r"(?<![\w$\\{])#", r"$", "comment"), Quote('"', '"', "string", True), Quote("'", "'", "string", True, "")), "none"),
    "graphql": Syntax((_HASH, _TRIPLE, _DOUBLE)),
    "protobuf": Syntax((*_C, _SINGLE)),
    "prisma": Syntax((_SLASHES, _DOUBLE)),
    "terraform": Syntax((_HASH, *_C)),
    "html": Syntax((_HTML,), "none"),
}
SYNTAX |= {"typescript": SYNTAX["javascript"], "svelte": SYNTAX["vue"], "scala": SYNTAX["kotlin"], "xml": SYNTAX["html"], "erb": SYNTAX["html"]}

#: words that open and close blocks; those of ``STATEMENT`` only where a statement begins, and a loop's own ``do`` opens nothing more
WORDS = {
    "ruby": r"\b(?:do|class|module|def|begin|case|if|unless|while|until|for|end)\b(?![?!:])",
    "elixir": r"\b(?:do(?!:)|fn|end)\b(?![?!:])",
}
STATEMENT = {"if", "unless", "while", "until", "for", "class", "module", "def", "begin", "case"}
LOOPS = {"while", "until", "for"}
_BRACKETS = {")": "(", "]": "[", "}": "{"}
#: a slash after one of these opens a pattern, not a division
_BEFORE_PATTERN = set("(,=:[!&|?{};~\n") | {""}
_PATTERN = re.compile(r"/(?![/*\s=>])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Reader(NamedTuple):
    syntax: Syntax
    opener: re.Pattern  # all openers, each a group q0, q1, ...
    code: re.Pattern  # the same and brackets or words
    closers: tuple[re.Pattern | None, ...]  # None: made from the opener


@lru_cache(maxsize=None)
def reader(language: str) -> Reader | None:
    syntax = SYNTAX.get(language)
    if syntax is None:
        return None
    parts = [f"(?P<q{n}>{q.opener})" for n, q in enumerate(syntax.quotes)]
    if syntax.heredocs:
        parts.insert(0, f"(?P<heredoc>{syntax.heredocs})")
    masks = parts + (["(?P<slash>/)"] if syntax.regex else []) + (["(?P<tick>`)", "(?P<brace>[{}])"] if syntax.templates else [])
    code = parts + (["(?P<slash>/)"] if syntax.regex else []) + (["(?P<tick>`)"] if syntax.templates else []) + [r"(?P<bracket>[()\[\]{}])"]
    if language in WORDS:
        code.append(rf"(?<![.:@$\w])(?P<word_>{WORDS[language]})")
    closers = []
    for q in syntax.quotes:
        if "(?P=" in q.closer:
            closers.append(None)
            continue
        closers.append(_closing(q, q.closer))
    return Reader(syntax, re.compile("|".join(masks), re.MULTILINE), re.compile("|".join(code), re.MULTILINE), tuple(closers))


@lru_cache(maxsize=256)
def _closing(q: Quote, closer: str) -> re.Pattern:
    """What ends a quote: its closer, past escaped characters, or the end of the line."""
    stops = ([q.escape] if q.escape and q.kind == "string" else []) + [rf"(?P<end>{closer})"] + ([] if q.lines or q.kind == "comment" else [r"(?P<line>$)"])
    return re.compile("|".join(stops), re.MULTILINE)


def _end_of(q: Quote, closing: re.Pattern, text: str, at: int, stop: int, nested: re.Pattern | None) -> int:
    depth = 1
    while at <= stop:
        m = closing.search(text, at, stop)
        if m is None:
            return stop
        if nested is not None:
            inner = nested.search(text, at, m.start())
            if inner:
                depth, at = depth + 1, inner.end()
                continue
        if m.lastgroup == "line":
            return m.start()
        if m.lastgroup == "end":
            depth -= 1
            if not depth:
                return m.end()
        at = max(m.end(), at + 1)
    return stop


_NESTED = re.compile(r"/\*")
_TEMPLATE = re.compile(r"\\[\s\S]|(?P<end>`)|(?P<hole>\$\{)")


def tokens(text: str, language: str, code: bool = False) -> Iterator[tuple[str, int, int]]:
    """(comment or string, start, end), and with ``code`` also each bracket and block word, in order."""
    r = reader(language)
    if r is None:
        return
    spans = [(m.start(1), m.end(1)) for m in re.finditer(r.syntax.within, text, re.DOTALL | re.IGNORECASE)] if r.syntax.within else [(0, len(text))]
    for start, stop in spans:
        yield from _tokens(text, r, start, stop, code)


def _tokens(text: str, r: Reader, at: int, stop: int, code: bool) -> Iterator[tuple[str, int, int]]:
    pattern = r.code if code else r.opener
    holes: list[int] = []  # depth of braces at each template expression that is open
    depth, below = 0, None  # below: (end of the line, start of the code after the texts announced in it)

    def template(at: int) -> tuple[int, int]:
        """(end of the literal's part, where code goes on)"""
        while m := _TEMPLATE.search(text, at, stop):
            if m.lastgroup == "end":
                return m.end(), m.end()
            if m.lastgroup == "hole":
                holes.append(depth)
                return m.start(), m.end()
            at = m.end()
        return stop, stop

    while m := pattern.search(text, at, stop):
        if below and m.start() >= below[0]:
            yield "string", below[0], below[1]
            at, below = below[1], None
            continue
        kind, s, at = m.lastgroup, m.start(), m.end()
        if kind == "heredoc":
            line = text.find("\n", at if below is None else below[1], stop)
            end = re.compile(rf"^[ \t]*{re.escape(m['word'])}\b", re.MULTILINE).search(text, line + 1, stop) if line >= 0 else None
            if end:
                below = (line if below is None else below[0], end.end())
        elif kind == "slash":
            before = text[max(0, s - 80) : s].rstrip(" \t")
            if (before[-1:] in _BEFORE_PATTERN or re.search(r"\b(?:return|typeof|case|in|of|when|if|unless|and|or)$", before)) and (p := _PATTERN.match(text, s, stop)):
                yield "string", s, p.end()
                at = p.end()
        elif kind == "tick":
            end, at = template(at)
            yield "string", s, end
        elif kind in ("brace", "bracket") and r.syntax.templates and m[0] in "{}":
            if m[0] == "}" and holes and holes[-1] == depth:
                holes.pop()
                end, at = template(at)
                yield "string", s, end
                continue
            depth += 1 if m[0] == "{" else -1
            if code:
                yield m[0], s, at
        elif kind in ("bracket", "word_"):
            yield m[0], s, at
        elif kind and kind[0] == "q":
            q = r.syntax.quotes[int(kind[1:])]
            closing = r.closers[int(kind[1:])] or _closing(q, q.closer.replace("(?P=hashes)", m["hashes"] or ""))
            at = _end_of(q, closing, text, at, stop, _NESTED if r.syntax.nested and q.lines and q.kind == "comment" else None)
            yield q.kind, s, at
            at = max(at, s + 1)
    if below:
        yield "string", below[0], below[1]


class Masks:
    """The comments and strings of a text; a place is masked if it stands behind the first character of one (for a comment, at it too)."""

    def __init__(self, text: str, language: str) -> None:
        self.all = list(tokens(text, language))
        self.starts = [s for _, s, _ in self.all]

    def kind(self, at: int) -> str | None:
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return None
        kind, start, end = self.all[k]
        return kind if start < at < end or (at == start and kind == "comment" and start < end) else None


class Block(NamedTuple):
    opener: str
    start: int  # of the opener
    body: int  # first place behind it
    end: int  # of the closer, or the text's
    parent: int  # its place in the list, -1: none


def blocks(text: str, language: str) -> list[Block]:
    """The blocks of a text by where they open; nested ones follow the ones around them."""
    r = reader(language)
    if r is None or r.syntax.blocks == "none":
        return []
    return _suites(text, language) if r.syntax.blocks == "indents" else _brackets(text, language, r.syntax.blocks == "words")


def _brackets(text: str, language: str, words: bool) -> list[Block]:
    out: list[list] = []
    open_: list[int] = []
    loop = -1  # end of the line on which a loop's own ``do`` may stand

    def shut(opener: str, at: int) -> None:
        for k in range(len(open_) - 1, -1, -1):
            if out[open_[k]][0] == opener:
                for inner in open_[k:]:
                    out[inner][3] = at
                del open_[k:]
                return

    for kind, s, e in tokens(text, language, True):
        if kind in ("comment", "string"):
            continue
        if kind in _BRACKETS:
            shut(_BRACKETS[kind], s)
            continue
        if kind == "end" and words:
            shut("do", s)
            continue
        opener = kind
        if words and kind.isalpha():
            before = text[max(0, s - 200) : s].rsplit("\n", 1)[-1].rstrip()
            if kind in STATEMENT and language == "ruby" and before and before[-1] not in "=(;,{|&[" and not re.search(r"\b(?:then|else|do|private|public|protected|memoize)$", before):
                continue  # a modifier behind its statement
            if kind in LOOPS:
                line = text.find("\n", e)
                loop = line if line >= 0 else len(text)
            elif kind == "do" and s < loop:
                loop = -1
                continue
            opener = "do"
        out.append([opener, s, e, len(text), open_[-1] if open_ else -1])
        open_.append(len(out) - 1)
    return [Block(*b) for b in out]


def _suites(text: str, language: str) -> list[Block]:
    """Indented suites: a line that ends in a colon opens one, the first line that is indented no more than it ends it."""
    masks = Masks(text, language)
    out: list[list] = []
    open_: list[tuple[int, int]] = []  # (margin, place in ``out``)
    depth = at = 0
    header = None
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        code = "".join(c if masks.kind(start + k) is None else ("" if masks.kind(start + k) == "comment" else "x") for k, c in enumerate(line)) if masks.all and _touched(masks, start, at) else line
        plain = code.strip()
        if not plain or (masks.kind(start) is not None):
            continue
        if not depth:
            margin = len(line) - len(line.lstrip())
            while open_ and open_[-1][0] >= margin:
                out[open_.pop()[1]][3] = start
            header = (margin, start + margin)
        depth = max(0, depth + sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}"))
        if not depth and plain.endswith(":") and header:
            out.append([":", header[1], at, len(text), open_[-1][1] if open_ else -1])
            open_.append((header[0], len(out) - 1))
    return [Block(*b) for b in out]


def _touched(masks: Masks, start: int, end: int) -> bool:
    k = bisect_right(masks.starts, end) - 1
    return k >= 0 and masks.all[k][2] > start


class Lines:
    """Numbers of lines, from 1, by place."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def _per_file(files: DataFrame, schema: str, kinds: list[pa.DataType], rows) -> DataFrame:
    """``rows(path, language, content)`` of each file, in Arrow batches of bounded bytes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for k in range(b.num_rows):
                path, language, content = (b.column(c)[k].as_py() for c in ("path", "language", "content"))
                held += rows(path, language, content)
                if len(held) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)

    src = files.filter(F.col("content").isNotNull() & F.col("language").isin(*SYNTAX)).select("path", "language", "content")
    return arrow_ready(src).mapInArrow(run, schema)


def lexical_masks(files: DataFrame) -> DataFrame:
    """path, kind (comment or string), start, end, line_start, line_end of every comment and string, by code points from 0."""

    def rows(path: str, language: str, content: str) -> list[tuple]:
        lines = Lines(content)
        return [(path, kind, s, e, lines.of(s), lines.of(max(s, e - 1))) for kind, s, e in tokens(content, language)]

    return _per_file(files, "path string, kind string, start long, end long, line_start int, line_end int", [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], rows)


def block_tree(files: DataFrame) -> DataFrame:
    """path, block (from 0), parent (or null), opener, start, end, line_start, line_end, header: the first line of each block."""

    def rows(path: str, language: str, content: str) -> list[tuple]:
        lines, out = Lines(content), []
        for n, b in enumerate(blocks(content, language)):
            first = content.rfind("\n", 0, b.start) + 1
            last = content.find("\n", b.start)
            header = content[first : last if last >= 0 else len(content)].strip()
            out.append((path, n, None if b.parent < 0 else b.parent, b.opener, b.start, b.end, lines.of(b.start), lines.of(min(b.end, max(0, len(content) - 1))), header))
        return out

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return _per_file(files, "path string, block int, parent int, opener string, start long, end long, line_start int, line_end int, header string", kinds, rows)
