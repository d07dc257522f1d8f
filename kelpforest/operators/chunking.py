"""Files to chunks: line windows, heading sections and symbols.

Cutting is sequential within a file, so it runs in Arrow batches, a file at a
time; files are independent and nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from kelpforest.constants import ATX_HEADING, FENCE, MAX_CHUNK, MIN_CHUNK, OVERLAP_LINES


@dataclass
class Piece:
    content: str
    start: int
    end: int
    symbol_type: str | None = None
    symbol_name: str | None = None
    heading_path: str | None = None


def line_windows(text: str, first: int = 1, most: int = MAX_CHUNK, least: int = MIN_CHUNK, overlap: int = OVERLAP_LINES) -> list[Piece]:
    """Greedy windows of whole lines that overlap; a short tail joins the window before it; a longer line is cut."""
    if not text.strip():
        return []
    lines = text.splitlines()
    if len(text) <= most:
        return [Piece(text, first, first + len(lines) - 1)]
    out: list[Piece] = []
    at = 0
    while at < len(lines):
        until, size = at, 0
        while until < len(lines) and (until == at or size + len(lines[until]) + 1 <= most):
            size += len(lines[until]) + 1
            until += 1
        body = "\n".join(lines[at:until])[:most]
        if out and len(body) < least:
            out[-1].content += "\n" + body
            out[-1].end = first + until - 1
        else:
            out.append(Piece(body, first + at, first + until - 1))
        if until >= len(lines):
            break
        at = max(until - overlap, at + 1)
    return out


_ATX, _FENCE = re.compile(ATX_HEADING), re.compile(FENCE)


def sections(text: str) -> list[tuple[list[str], int, int]]:
    """(trail of headings, first line, line after the last), lines from 0. Headings in fences don't count."""
    lines = text.splitlines()
    out: list[tuple[list[str], int, int]] = []
    stack: list[tuple[int, str]] = []
    start, fence = 0, None
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            fence = m[1] if fence is None else None if fence == m[1] else fence
            continue
        if fence is not None:
            continue
        level = title = None
        begin = i
        if m := _ATX.match(line):
            level, title = len(m[1]), m[2]
        elif i and lines[i - 1].strip() and re.fullmatch(r"(=+|-{3,})\s*", line) and not _ATX.match(lines[i - 1]):
            level, title, begin = (1 if line[0] == "=" else 2), lines[i - 1].strip(), i - 1
        if level is None:
            continue
        if begin > start:
            out.append(([t for _, t in stack], start, begin))
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        start = begin
    if start < len(lines):
        out.append(([t for _, t in stack], start, len(lines)))
    return out


def heading_sections(text: str, most: int = MAX_CHUNK, least: int = MIN_CHUNK) -> list[Piece]:
    """A chunk per section; small ones fold into the chunk before, large ones are cut in windows that keep the trail."""
    lines = text.splitlines()
    out: list[Piece] = []
    for trail, a, z in sections(text):
        body = "\n".join(lines[a:z]).strip("\n")
        if not body.strip():
            continue
        path = " > ".join(trail) or None
        name = trail[-1] if trail else None
        if len(body) < least and out:
            out[-1].content += "\n\n" + body
            out[-1].end = z
        elif len(body) <= most:
            out.append(Piece(body, a + 1, z, "section", name, path))
        else:
            for w in line_windows("\n".join(lines[a:z]), a + 1, most, least):
                out.append(Piece(w.content, w.start, w.end, "section", name, path))
    return out


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    body: int | None = None  # first line of members, of containers
    members: tuple = ()


def _python_symbols(text: str) -> list[Symbol]:
    def of(nodes) -> list[Symbol]:
        out = []
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                if isinstance(n, ast.ClassDef):
                    inner = of(n.body)
                    out.append(Symbol("class", n.name, start, n.end_lineno, inner[0].start if inner else n.end_lineno + 1, tuple(inner)))
                else:
                    out.append(Symbol("function", n.name, start, n.end_lineno))
        return out

    return of(ast.parse(text).body)


#: Kinds by the word that introduces them, for languages with braces.
_BRACED = re.compile(
    r"^(?P<indent>\s*+)(?:(?:export|default|public|private|protected|internal|static|abstract|final|async|pub(?:\([a-z]+\))?|unsafe|sealed|partial|override)\s+)*"
    r"(?:(?P<kind>class|interface|enum|struct|trait|impl|mod|record|namespace|type|function|fn|func)\b[\s*]*(?:<[^>]*>\s*)?(?P<receiver>\([^)]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*)?"
    r"|(?P<const>const|let)\s+(?P<cname>[A-Za-z_$][\w$]*)\s*=)"
)
#: What may stand before types, modifiers and a name in front of a parenthesis; a body must follow. Nothing here is tried twice, so a long line costs its length.
_LEAD = re.compile(r"\s*+(?:@\w++(?:\([^)]*\))?+\s++)*+")
_HEAD = re.compile(r"[\w$<>\[\],.?&*:\s~]*+")
_NAME_TAIL = re.compile(r"[\w$]*+")
_NAME_START = re.compile(r"[A-Za-z_$]")
_NO_NAMES = frozenset("if for while switch catch return else do try new throw function sizeof using lock when match assert super this yield await foreach elif".split())
_KINDS = {"fn": "function", "func": "function", "mod": "module", "namespace": "module"}
_CONTAINERS = {"class", "impl", "trait", "module"}
#: Grammars whose callables inside containers are methods, and those with callables outside of them that no word introduces.
_METHODS = {"typescript", "tsx", "javascript", "java", "csharp", "php", "cpp", "go"}
_FREE = {"c", "cpp", "bash"}


#: Strings of one line, comments, and what else hides braces, by grammar.
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?", r"'(?:\\.|[^'\\\n])*'?"
_LONG = r"\"(?:\\.|[^\"\\])*(?:\"|\Z)", r"'(?:\\.|[^'\\])*(?:'|\Z)"
_TEXT_BLOCK = r"\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)"
_SCRIPT = (_BLOCK, _LINE, *_QUOTED, "(?P<template>`)", r"(?P<slash>/)")
_HIDES = {
    "java": (_BLOCK, _LINE, _TEXT_BLOCK, *_QUOTED),
    "csharp": (_BLOCK, _LINE, r"\$*@\$*\"(?:\"\"|[^\"])*(?:\"|\Z)", _TEXT_BLOCK, *_QUOTED),
    "go": (_BLOCK, _LINE, r"`[^`]*(?:`|\Z)", *_QUOTED),
    "rust": (_BLOCK, _LINE, r"\br(?P<hashes>#*)\".*?(?:\"(?P=hashes)|\Z)", _LONG[0], r"'(?:\\[^'\n]*|[^\\'\n])'"),
    "php": (_BLOCK, _LINE, r"\#(?!\[)[^\n]*", r"<<<\s*[\"']?(?P<here>\w+)[\"']?", *_LONG),
    "bash": (r"(?<![^\s;&|(])\#[^\n]*", r"<<-?\s*[\"'\\]?(?P<here>\w+)[\"']?", r"\\.", _LONG[0], r"'[^']*(?:'|\Z)"),
    "scss": (_BLOCK, r"(?<!:)//[^\n]*", *_QUOTED),
    "css": (_BLOCK, *_QUOTED),
} | dict.fromkeys(("typescript", "tsx", "javascript"), _SCRIPT)
_SCANS = {grammar: re.compile("|".join(parts), re.S) for grammar, parts in _HIDES.items()}
_OTHER = re.compile("|".join((_BLOCK, _LINE, *_QUOTED)), re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Where a slash begins a regular expression and doesn't divide.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|yield|await))[ \t]*\Z")


def _template_end(text: str, i: int, scan: re.Pattern) -> int:
    """Behind the backquote that closes the template which opens at ``i``; code in it may hold templates again."""
    i += 1
    while i < len(text) and text[i] != "`":
        if text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i, scan)
                    continue
                m = scan.match(text, i)
                if m and not m["slash"]:
                    i = m.end()
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 2 if text[i] == "\\" else 1
    return i + 1


def masked(text: str, grammar: str) -> str:
    """The text with blanks in place of comments, strings, templates, here-documents and regular expressions; lines and places stay."""
    scan, out, at, done = _SCANS.get(grammar, _OTHER), [], 0, 0
    while m := scan.search(text, at):
        start, end = m.span()
        named = m.groupdict()
        if named.get("template"):
            end = _template_end(text, start, scan)
        elif named.get("slash"):
            literal = _REGEX.match(text, start) if _BEFORE_REGEX.search(text, max(0, start - 40), start) else None
            end = literal.end() if literal else start
        elif named.get("here"):
            closing = re.compile(rf"^[ \t]*{named['here']}\b.*$" if grammar == "php" else rf"^\t*{named['here']}$", re.M).search(text, text.find("\n", end) + 1 or len(text))
            start, end = (text.find("\n", end) if "\n" in text[end:] else len(text)), closing.end() if closing else len(text)
        at = max(end, m.end() if start == m.start() else start)
        if end > start:
            out += [text[done:start], re.sub(r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " ", text[start:end])]
            done, at = end, max(end, m.start() + 1)
    return "".join([*out, text[done:]])


def _block_end(lines: list[str], i: int, z: int) -> tuple[int, bool]:
    """The last of masked lines of what starts at line ``i``, and whether braces were seen: a balanced block, or up to a semicolon."""
    depth, seen = 0, False
    for j in range(i, z):
        bare = lines[j]
        depth += bare.count("{") - bare.count("}")
        seen |= "{" in bare
        if (seen and depth <= 0) or (not seen and bare.rstrip().endswith(";")):
            return j, seen
    return z - 1, seen


def _named_call(line: str) -> tuple[str, str, int] | None:
    """(head, name, place of the parenthesis) of a line that calls or defines something: its first parenthesis, the name before it, and what stands before that."""
    begin = _LEAD.match(line).end()
    paren = line.find("(", begin)
    if paren < 0:
        return None
    before = line[begin:paren].rstrip()
    start = len(before) - _NAME_TAIL.match(before[::-1]).end()
    if start and before[start - 1] in "~#":
        start -= 1
    elif m := _NAME_START.search(before, start):
        start = m.start()
    else:
        return None
    return (before[:start], before[start:], paren) if _HEAD.fullmatch(before, 0, start) else None


def _callable(lines: list[str], i: int, z: int, typed: bool) -> str | None:
    """The name of what a line defines, if a parameter list and a body in braces follow it."""
    head, name, paren = _named_call(lines[i]) or ("", "", 0)
    if not name or name in _NO_NAMES or set(head.split()) & _NO_NAMES or (typed and not head.strip()) or "=" in head:
        return None
    depth = 0
    for j in range(i, min(z, i + 20)):
        for c in lines[j][paren if j == i else 0 :]:
            depth += (c == "(") - (c == ")")
            if depth <= 0 and c in "{;=":
                return name if c == "{" else None
    return None


def _braced_symbols(lines: list[str], a: int, z: int, grammar: str, inside: bool = False) -> list[Symbol]:
    """Definitions by keyword, or by name and parameters, and balanced braces; a scanner, not a grammar."""
    out, i = [], a
    while i < z:
        m = _BRACED.match(lines[i])
        name = kind = None
        if m and (m["kind"] or m["const"]) and not (grammar in ("c", "cpp") and m["kind"] == "struct" and "{" not in "".join(lines[i : i + 2])):
            kind = _KINDS.get(m["kind"], m["kind"]) if m["kind"] else "const"
            name = m["name"] or m["cname"] or ""
            if kind == "function" and ((inside and grammar in _METHODS) or (grammar == "go" and m["receiver"])):
                kind = "method"
        elif (inside and grammar in _METHODS) or (not inside and grammar in _FREE):
            name = _callable(lines, i, z, typed=not inside and grammar != "bash")
            kind = "method" if inside and grammar != "cpp" else "function"
        if name is None:
            i += 1
            continue
        end, seen = _block_end(lines, i, z)
        inner = tuple(_braced_symbols(lines, i + 1, end, grammar, True)) if kind in _CONTAINERS and seen else ()
        out.append(Symbol(kind, name, i + 1, end + 1, inner[0].start if inner else end + 2, inner))
        i = end + 1
    return out


_RUBY = re.compile(r"^(?P<indent>\s*)(?P<kind>def|class|module)\s+(?P<name>[A-Za-z_][\w.:]*[?!=]?)")


def _ruby_symbols(lines: list[str], a: int, z: int) -> list[Symbol]:
    """Definitions from their word to the ``end`` that stands as far in."""
    out, i = [], a
    while i < z:
        m = _RUBY.match(lines[i])
        if not m:
            i += 1
            continue
        closing = m["indent"] + "end"
        end = i if re.search(r"\bend\s*$", lines[i]) else next((j for j in range(i + 1, z) if lines[j].rstrip() == closing), i)
        kind = "method" if m["kind"] == "def" else m["kind"]
        inner = tuple(_ruby_symbols(lines, i + 1, end)) if kind != "method" else ()
        out.append(Symbol(kind, m["name"].removeprefix("self."), i + 1, end + 1, inner[0].start if inner else end + 2, inner))
        i = end + 1
    return out


_SQL = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+|materialized\s+)*(table|view|function)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", re.I)


def _sql_symbols(lines: list[str]) -> list[Symbol]:
    """Statements up to their semicolon; a body in dollar quotes belongs to its statement."""
    out, i = [], 0
    while i < len(lines):
        if not lines[i].strip() or lines[i].lstrip().startswith("--"):
            i += 1
            continue
        quoted, end = False, i
        for j in range(i, len(lines)):
            quoted ^= len(re.findall(r"\$\w*\$", lines[j])) % 2 == 1
            end = j
            if not quoted and lines[j].split("--")[0].rstrip().endswith(";"):
                break
        m = _SQL.match(" ".join(lines[i : min(end + 1, i + 3)]))
        out.append(Symbol(m[1].lower() if m else "statement", m[2].strip('"`') if m else "", i + 1, end + 1))
        i = end + 1
    return out


def _css_symbols(lines: list[str], bare: list[str]) -> list[Symbol]:
    out, i = [], 0
    while i < len(lines):
        head = lines[i].split("{")[0].strip()
        if not head or head.startswith(("/*", "//", "*", "@import", "@use", "$")) or "{" not in "".join(bare[i : i + 3]):
            i += 1
            continue
        end, _ = _block_end(bare, i, len(lines))
        kind = "media" if head.startswith("@media") else "mixin" if head.startswith("@mixin") else "rule"
        out.append(Symbol(kind, head.split("(")[0].removeprefix("@mixin").strip() if kind == "mixin" else head, i + 1, end + 1))
        i = end + 1
    return out


_TAG = re.compile(r"^\s*<([A-Za-z][\w-]*)")


def _html_symbols(lines: list[str]) -> list[Symbol]:
    """Elements that start a line outside of any other, up to their closing tag."""
    out, i = [], 0
    while i < len(lines):
        m = _TAG.match(lines[i])
        if not m:
            i += 1
            continue
        depth, end = 0, i
        for j in range(i, len(lines)):
            depth += len(re.findall(rf"<{m[1]}\b(?![^>]*/>)", lines[j])) - len(re.findall(rf"</{m[1]}\s*>", lines[j]))
            if depth <= 0:
                end = j
                break
        out.append(Symbol("element", m[1], i + 1, end + 1))
        i = end + 1
    return out


def symbols(text: str, grammar: str) -> list[Symbol]:
    """Definitions of a file, nested in their containers; none where it can't be read."""
    lines = text.splitlines()
    try:
        if grammar == "python":
            return _python_symbols(text)
        if grammar == "ruby":
            return _ruby_symbols(lines, 0, len(lines))
        if grammar in ("sql", "html"):
            return {"sql": _sql_symbols, "html": _html_symbols}[grammar](lines)
        bare = masked(text, grammar).splitlines()
        return _css_symbols(lines, bare) if grammar in ("css", "scss") else _braced_symbols(bare, 0, len(bare), grammar)
    except (SyntaxError, ValueError, RecursionError):
        return []


def symbol_chunks(text: str, grammar: str, most: int = MAX_CHUNK, least: int = MIN_CHUNK) -> list[Piece]:
    """A chunk per definition, containers split into header and members, leftovers grouped as ``module``; windows if nothing is found."""
    lines = text.splitlines()
    claimed: set[int] = set()
    out: list[Piece] = []

    def take(kind: str, name: str, a: int, z: int) -> None:
        body = "\n".join(lines[a - 1 : z])
        if len(body.strip()) < least:
            return
        claimed.update(range(a, z + 1))
        parts = [Piece(body, a, z)] if len(body) <= most else line_windows(body, a, most, least)
        out.extend(Piece(p.content, p.start, p.end, kind, name) for p in parts)

    def walk(found, prefix: str) -> None:
        for s in found:
            name = prefix + s.name
            if s.body is None or not s.members:
                take(s.kind, name, s.start, s.end)
            else:
                take(s.kind, name, s.start, s.body - 1)
                walk(s.members, name + ".")

    walk(symbols(text, grammar), "")
    if not out:
        return line_windows(text, 1, most, least)
    run: list[int] = []

    def leftovers() -> None:
        while run and not lines[run[0] - 1].strip():
            run.pop(0)
        body = "\n".join(lines[n - 1] for n in run)
        if len(body.strip()) >= least:
            parts = [Piece(body, run[0], run[-1])] if len(body) <= most else line_windows(body, run[0], most, least)
            out.extend(Piece(p.content, p.start, min(p.end, len(lines)), "module") for p in parts)
        run.clear()

    size = 0
    for n in range(1, len(lines) + 1):
        if n in claimed:
            continue
        if run and size + len(lines[n - 1]) + 1 > most:
            leftovers()
            size = 0
        run.append(n)
        size += len(lines[n - 1]) + 1
    leftovers()
    return sorted(out, key=lambda p: p.start)


def chunk_text(text: str | None, chunker: str | None, grammar: str | None) -> list[Piece]:
    if not text or not text.strip():
        return []
    if chunker not in (None, "docs", "code", "text"):
        raise ValueError(f"no chunker is named {chunker}")
    found = heading_sections(text) if chunker == "docs" else symbol_chunks(text, grammar or "") if chunker == "code" else line_windows(text)
    return found or line_windows(text)


SCHEMA = "key string, chunk_index int, chunk_total int, start_line int, end_line int, content string, symbol_type string, symbol_name string, heading_path string"


def _chunked(carried: tuple[str, ...], catch: bool):
    """Chunks of a batch of files; with ``catch``, a file that can't be cut is a row with its error."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    names = [*(f.split()[0] for f in SCHEMA.split(", ")[1:]), "error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, rows, of = batch.slice(at, 256), [], []
                for i, (text, kind, grammar) in enumerate(zip(*(some.column(n).to_pylist() for n in ("text", "chunker", "grammar")), strict=True)):
                    try:
                        pieces = chunk_text(text, kind, grammar)
                    except Exception as e:
                        if not catch:
                            raise
                        rows.append((None,) * 8 + (f"{type(e).__name__}: {e}",))
                        of.append(i)
                        continue
                    rows += [(k, len(pieces), p.start, p.end, p.content, p.symbol_type, p.symbol_name, p.heading_path, None) for k, p in enumerate(pieces)]
                    of += [i] * len(pieces)
                where = pa.array(of, pa.int64())
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.record_batch([*(some.column(c).take(where) for c in carried), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*carried, *names])

    return run


def chunk(files: DataFrame, carry: tuple[str, ...] = (), catch: bool = False) -> DataFrame:
    """Chunks of files (key, text, chunker, grammar); see ``SCHEMA``. ``carry`` names columns of files to keep; ``catch`` adds ``error``."""
    carried = ("key", *carry)
    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carried)
    rest = ", ".join(SCHEMA.split(", ")[1:])
    out = files.select(*carried, *(c for c in ("text", "chunker", "grammar") if c not in carried)).mapInArrow(_chunked(carried, catch), f"{kept}, {rest}, error string")
    return out if catch else out.drop("error")
