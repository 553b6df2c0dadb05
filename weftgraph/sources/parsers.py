"""Definitions and calls in source text.

Python is parsed with the standard library, and by a tolerant pass where that fails: definitions by
their heads and indentation, calls statement by statement.  Rust, JavaScript and TypeScript have no parser
here; a scanner blanks strings and comments, finds definitions by their keywords and their
ends by matching braces.  It covers the usual forms; macros, decorators that build
code, regular expressions that hold braces, and arrow functions are beyond it.
"""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_left
from dataclasses import dataclass


@dataclass(frozen=True)
class Definition:
    kind: str
    name: str
    start_line: int
    end_line: int
    text: str
    begin: int
    end: int


_KEYWORDS = {
    "rust": [("function", r"\bfn\s+([A-Za-z_]\w*)"), ("struct", r"\bstruct\s+([A-Za-z_]\w*)"), ("enum", r"\benum\s+([A-Za-z_]\w*)"), ("trait", r"\btrait\s+([A-Za-z_]\w*)")],
    "javascript": [("function", r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"\bclass\s+([A-Za-z_$][\w$]*)")],
    "typescript": [("function", r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("interface", r"\binterface\s+([A-Za-z_$][\w$]*)")],
}
_METHOD = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\([^;{}]*\)\s*(?::\s*[^;{}=]+)?\{")
_NOT_CALLED = set("if for while switch catch return function fn match loop else do in of typeof await new struct enum trait impl class interface constructor super".split())
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:::\s*<[^>()]*>\s*)?)\(")
PARSED = ("python", "rust", "javascript", "typescript")


def blank(source: str, lang: str) -> str:
    """The source with strings and comments as blanks, position by position."""
    if lang == "rust":
        pattern = r'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\])\''
    else:
        pattern = r'//[^\n]*|/\*.*?\*/|()"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group(0)), source, flags=re.S)


def _closing(code: str, at: int) -> int:
    """Position after the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return at + m.end()
    return len(code)


def _scan(source: str, lang: str) -> list[Definition]:
    code = blank(source, lang)
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in _KEYWORDS[lang]:
        for m in re.finditer(pattern, code):
            stop = re.compile(r"[{;]").search(code, m.end())
            if not stop:
                continue
            if stop.group() == ";":
                if lang == "rust" and kind in ("struct",):
                    found.append((m.start(), stop.end(), kind, m.group(1)))
                continue
            found.append((m.start(), _closing(code, stop.start()), kind, m.group(1)))
    if lang != "rust":
        classes = [(b, e) for b, e, k, _ in found if k == "class"]
        for m in _METHOD.finditer(code):
            name, at = m.group(1), m.start(1)
            if name in _NOT_CALLED - {"constructor"} or not any(b < at < e for b, e in classes):
                continue
            inner = [f for f in found if f[2] in ("function",) and f[0] < at < f[1]]
            if not inner:
                found.append((at, _closing(code, m.end() - 1), "method", name))
    lines = lambda k: source.count("\n", 0, k) + 1
    return [Definition(k, n, lines(b), lines(max(b, e - 1)), source[b:e], b, e) for b, e, k, n in sorted(found)]


_PY_TOKEN = re.compile(r"""#[^\n]*|(\"{3}|'{3})|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)""", re.S)
_PY_HEAD = re.compile(r"(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)[ \t]*(?=[\[(:])")
_PY_HEAD_LINE = re.compile(r"(?m)^[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[\[(]|class[ \t]+\w+[ \t]*[\[(:])")
#: Words that begin a statement and cannot stand inside brackets.
_PY_STATEMENT = re.compile(r"[ \t]*(?:async[ \t]+def|def|class|return|import|raise|while|try|del|assert|pass|break|continue|with|global|nonlocal)\b")
_PY_COMPOUND = re.compile(r"(?:async|def|class|if|elif|else|for|while|with|try|except|finally|match|case)\b")
_PY_CALL = re.compile(r"(?<!\w)([^\W\d]\w*)\(")
_PY_BROKEN = (SyntaxError, ValueError, RecursionError, MemoryError)


def _blank_python(source: str) -> tuple[str, set[int]]:
    """The source with comments as blanks and strings as quotation marks, and the starts of lines inside strings.

    A triple quote without a partner, or one that would swallow a definition while their number is odd, ends with its line.
    """
    other = {'"""': "'", "'''": '"'}
    marks = {q: [m.start() for m in re.finditer(f"(?<!{o}){q}|{q}(?!{o})", source)] for q, o in other.items()}  # quoted ones are none
    out, inside, at = [], set(), 0
    while m := _PY_TOKEN.search(source, at):
        begin, end, quote = m.start(), m.end(), m.group(1)
        if quote:
            close = re.compile(r"(?:\\.|(?!" + quote + r")[^\\])*+" + quote, re.S).match(source, end)
            odd = (len(marks[quote]) - bisect_left(marks[quote], begin)) % 2
            if close and not (odd and _PY_HEAD_LINE.search(source, end, close.end())):
                end = close.end()
            else:
                end = source.find("\n", end) % (len(source) + 1)
        text = source[begin:end]
        inside.update(begin + k.end() for k in re.finditer("\n", text))
        out += [source[at:begin], re.sub(r"[^\n]", " " if text[0] == "#" else '"', text)]
        at = end
    return "".join(out) + source[at:], inside


def _brackets(code: str) -> dict[int, int]:
    """Closing positions by opening ones; what is not closed before the next statement is no bracket."""
    pairs, open_, match = {")": "(", "]": "[", "}": "{"}, [], {}
    held = dict.fromkeys("([{", 0)
    for m in re.finditer(r"(?m)[()\[\]{}]|^(?=[ \t]*[a-z])", code):
        c = m.group()
        if not c:
            if open_ and _PY_STATEMENT.match(code, m.start()):
                open_, held = [], dict.fromkeys("([{", 0)
        elif c in held:
            open_.append((c, m.start()))
            held[c] += 1
        elif held[pairs[c]]:
            while True:
                o, k = open_.pop()
                held[o] -= 1
                if o == pairs[c]:
                    break
            match[k] = m.start()
    return match


def _logical_lines(code: str, inside: set[int], match: dict[int, int]) -> list[tuple[int, int, int]]:
    """``begin, end, indentation`` of statements: lines joined within strings, brackets and after backslashes."""
    out, at = [], 0
    opens = sorted(match)
    while at < len(code):
        eol = code.find("\n", at) % (len(code) + 1)
        head = re.compile(r"[ \t\f\r]*").match(code, at, eol).end()
        if head == eol:
            at = eol + 1
            continue
        k = bisect_left(opens, at)
        while True:
            far = eol
            while k < len(opens) and opens[k] < eol:
                far = max(far, match[opens[k]])
                k += 1
            if far == eol and eol + 1 not in inside and not code[at:eol].rstrip("\r").endswith("\\"):
                break
            if eol >= len(code):
                break
            eol = code.find("\n", max(far, eol + 1)) % (len(code) + 1)
        white = code[at:head].rpartition("\f")[2].replace("\r", "")
        out.append((head, head + len(code[head:eol].rstrip()), len(white.expandtabs(8))))
        at = eol + 1
    return out


def _head(code: str, begin: int, end: int, match: dict[int, int]) -> re.Match | None:
    """The head of a definition if a whole one begins the statement: its brackets closed, its colon there."""
    m = _PY_HEAD.match(code, begin, end)
    if not m:
        return None
    at, seen = m.end(), False
    while at < end and code[at] != ":":
        if code[at] in "([{":
            if at not in match:
                return None
            seen |= code[at] == "("
            at = match[at]
        at += 1
    return m if at < end and (seen or m.group(1) == "class") else None


def _statement_calls(source: str, code: str, begin: int, end: int) -> list[tuple[str, int]]:
    """Calls of one statement, which may be the head of a compound one; by pattern if it does not parse."""
    text, before, after = source[begin:end], "", ""
    word = re.match(r"@|\w*", text).group()
    if code[end - 1] == ":":
        after = " pass"
    if word in ("else", "elif"):
        before = "if 0: pass\n"
    elif word in ("except", "finally"):
        before = "try: pass\n"
    elif word == "case":
        before = "match 0:\n "
    elif word == "@":
        after = "\ndef _(): pass"
    elif word == "try":
        after += "\nfinally: pass"
    elif word == "match" and after:
        after = "\n case _: pass"
    try:
        return [(name, begin + at - len(before)) for name, at in _tree_calls(before + text + after, ast.parse(before + text + after))]
    except _PY_BROKEN:
        named = [(m.group(1), m.start()) for m in _PY_CALL.finditer(code, begin, end) if not keyword.iskeyword(m.group(1))]
        return [(n, k) for n, k in named if not re.search(r"\b(?:def|class)[ \t]+\Z", code[max(begin, k - 20) : k])]


def _recover(source: str) -> tuple[list[Definition], list[tuple[str, int]]]:
    """Definitions and calls of Python that does not parse as a whole.

    A definition needs a whole head and reaches as far as its lines are indented.  Lines that are
    indented without cause go on with the definition before them, what lies between is not part of
    it, and its calls count for nothing.
    """
    source, given = re.sub(r"\r(?!\n)", "\n", source), source
    code, inside = _blank_python(source)
    match = _brackets(code)
    found, sites, open_, was = [], [], [], []
    gap, left, last = [], 0, (0, False)  # calls since a definition was left; indentation of the last statement, and whether a block follows it
    for begin, end, indent in _logical_lines(code, inside, match):
        if was and indent > last[0] and not last[1]:
            back = [d for d in was if d[4] < indent]
            if len(back) > len([d for d in open_ if d[4] < indent]):
                open_, sites, was = back, sites[:left], []
        keep = [d for d in open_ if d[4] < indent]
        if len(keep) < len(open_) and not was:
            was, left = open_, len(sites)
        open_ = keep
        head = _head(code, begin, end, match)
        if head:
            was = []
            open_ = [*open_, [head.group(1), head.group(2), begin, end, indent]]
            found.append(open_[-1])
        for d in open_:
            d[3] = end
        sites += _statement_calls(source, code, begin, end)
        last = indent, code[end - 1] == ":" and bool(_PY_COMPOUND.match(code, begin))
    line = lambda k: source.count("\n", 0, k) + 1
    defs = [Definition("class" if k == "class" else "function", n, line(b), line(e - 1), given[b:e], b, e) for k, n, b, e, _ in found]
    return defs, sites


def _tree_calls(source: str, tree: ast.AST) -> list[tuple[str, int]]:
    starts = [0]
    rows = source.split("\n")
    for line in rows:
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                out.append((name, starts[node.lineno - 1] + len(rows[node.lineno - 1].encode()[: node.col_offset].decode("utf-8", "ignore"))))
    return sorted(out, key=lambda x: x[1])


def definitions(source: str, lang: str) -> list[Definition]:
    """Definitions in order of position; none for languages that are not parsed.  Python that does not parse gives those that are whole."""
    if lang == "python":
        try:
            tree = ast.parse(source)
        except _PY_BROKEN:
            return _recover(source)[0]
        starts = [0]
        for line in source.split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        rows = source.split("\n")
        place = lambda line, col: starts[line - 1] + len(rows[line - 1].encode()[:col].decode("utf-8", "ignore"))
        out = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                b, e = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
                out.append(Definition("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, source[b:e], b, e))
        return sorted(out, key=lambda d: (d.begin, -d.end))
    return _scan(source, lang) if lang in _KEYWORDS else []


def call_sites(source: str, lang: str) -> list[tuple[str, int]]:
    """Called names with their positions."""
    if lang == "python":
        try:
            tree = ast.parse(source)
        except _PY_BROKEN:
            return _recover(source)[1]
        return _tree_calls(source, tree)
    if lang not in _KEYWORDS:
        return []
    code = blank(source, lang)
    heads = {d.begin + code[d.begin : d.end].find(d.name) for d in definitions(source, lang)}
    out = []
    for m in _CALL.finditer(code):
        before = code[: m.start(1)].rstrip()[-8:]
        if m.group(1) not in _NOT_CALLED and m.start(1) not in heads and not re.search(r"\b(?:fn|function|new|struct)\s*\*?\Z", before):
            out.append((m.group(1), m.start(1)))
    return out


def calls(source: str, lang: str) -> list[tuple[str, str]]:
    """``(enclosing, called)`` for each call inside a definition that is not to that definition's own name."""
    defs = definitions(source, lang)
    out = []
    for name, at in call_sites(source, lang):
        around = [d for d in defs if d.begin <= at < d.end]
        if around:
            inner = min(around, key=lambda d: d.end - d.begin)
            if inner.name != name:
                out.append((inner.name, name))
    return out
