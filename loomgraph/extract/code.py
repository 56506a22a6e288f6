"""Definitions, containment and calls of source files. Python by its own parser, JavaScript and Java by tokens and their brackets."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.config import CODE_FORMATS
from loomgraph.schemas import _C, _T
from loomgraph.session import spread

EXTRACTED = f"source_file string, triples array<struct<{_T}>>, concepts array<struct<{_C}>>, failed boolean"


class Structure:
    """Collects triples and concepts of one file, as definitions and calls come."""

    def __init__(self, module: str, suffix: str) -> None:
        self.module, self.triples, self.about = module, {}, {module: ("module", f"module {module} ({suffix})")}
        self.scopes: list[tuple[str, str]] = []

    def _add(self, head: str, relation: str, tail: str) -> None:
        if head != tail:
            self.triples.setdefault((head, relation, tail), None)

    def owner(self) -> str | None:
        return next((n for k, n in reversed(self.scopes) if k == "class"), None)

    def define(self, kind: str, name: str, params: str = "") -> None:
        """kind is class, method or function; a method need not be in a class (object literals, interfaces)."""
        owner = self.owner() if kind == "method" else None
        if owner is not None:
            self._add(owner, "contains", name)
        self.about[name] = (kind, f"class {name}" if kind == "class" else f"{kind} {owner + '.' if owner else ''}{name}({params})")
        if not self.scopes and kind != "method":
            self._add(self.module, "defines", name)
        self.scopes.append((kind, name))

    def leave(self) -> None:
        self.scopes.pop()

    def call(self, callee: str) -> None:
        caller = next((n for k, n in reversed(self.scopes) if k != "class"), self.module)
        self.about.setdefault(callee, ("function", f"function {callee}"))
        self._add(caller, "calls", callee)


def _spaces(text: str) -> str:
    return " ".join(text.split())


class _Python(ast.NodeVisitor):
    def __init__(self, out: Structure, source: str) -> None:
        self.out, self.source = out, source

    def _params(self, node) -> str:
        text = ast.get_source_segment(self.source, node) or ""
        at = text.find("(", text.find(node.name))
        depth = 0
        for i in range(at, len(text)):
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(text[i], 0)
            if not depth:
                return _spaces(text[at + 1 : i])
        return ""

    def _define(self, node, kind: str, params: str = "") -> None:
        for x in node.decorator_list:  # calls of the scope around
            self.visit(x)
        self.out.define(kind, node.name, params)
        node.decorator_list = []
        self.generic_visit(node)
        self.out.leave()

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        self._define(node, "class")

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        self._define(node, "function" if self.out.owner() is None else "method", self._params(node))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node) -> None:  # noqa: N802
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.out.call(name)
        self.generic_visit(node)


_SPACE = r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_LITERAL = r"|(?P<literal>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|\d\w*(?:\.\d\w*)?)"
_NEXT = re.compile(_SPACE + _LITERAL + r"|(?P<word>#?(?:[^\W\d]|\$)[\w$]*)|(?P<sign>=>|->|\?\.(?!\d)|\.\.\.|\S)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_OPERAND = {")", "]", "}"}
#: After these a JavaScript function or class is an expression, and a slash begins a pattern.
_EXPECT = set("= ( , [ ? : ! & | ^ ~ + - * / % < > => ... return typeof void delete await yield new in of instanceof case throw extends do else".split())
_JS_WORDS = set("if for while switch catch with return typeof void delete throw in instanceof new function super import yield await case do else".split())
_JAVA_WORDS = set("if for while switch catch return synchronized try throw else do assert case this super new yield".split())
_MODIFIERS = set("public protected private static final abstract native synchronized strictfp default".split())


class _Tokens:
    """Tokens of JavaScript or Java without comments; code inside template strings is in brackets of its own."""

    def __init__(self, source: str, language: str) -> None:
        self.source, self.text, self.kind, self.start, self.end = source, [], [], [], []
        js, at, depth, held, template = language == "javascript", 0, 0, [], False
        while at < len(source):
            if template:
                at, template = _TEMPLATE.match(source, at).end(), False
                if source.startswith("${", at):
                    self._add("(", "sign", at, at + 2)
                    held.append(depth)
                    at += 1
                at += 1
                continue
            m = _NEXT.match(source, at)
            kind, t, after = m.lastgroup, m[0], m.end()
            if js and t == "/" and (not self.text or self.text[-1] in _EXPECT or self.kind[-1] == "sign" and self.text[-1] not in _OPERAND):
                found = _REGEX.match(source, at)
                kind, after = ("literal", found.end()) if found else (kind, after)
            elif js and t == "`":
                template = True
            elif t == "{":
                depth += 1
            elif t == "}" and held and held[-1] == depth:
                held.pop()
                t, template = ")", True
            elif t == "}":
                depth -= 1
            if kind != "space":
                self._add(t if kind != "literal" else '"', kind, at, after)
            at = after
        self.closing, stack = {}, []
        for i, t in enumerate(self.text):
            if t in ("(", "[", "{"):
                stack.append(i)
            elif t in _OPERAND:
                while stack and (self.text[stack[-1]], t) not in (("(", ")"), ("[", "]"), ("{", "}")):
                    stack.pop()  # never closed
                if stack:
                    self.closing[stack.pop()] = i

    def _add(self, t: str, kind: str, start: int, end: int) -> None:
        for held, x in ((self.text, t), (self.kind, kind), (self.start, start), (self.end, end)):
            held.append(x)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "word"

    def close(self, i: int) -> int:
        return self.closing.get(i, len(self.text))

    def first(self, i: int, wanted: str) -> int:
        """The next of the wanted signs from i on, outside of round brackets."""
        while i < len(self.text) and self.text[i] not in wanted:
            i = self.close(i) + 1 if self.text[i] == "(" else i + 1
        return i

    def dotted(self, i: int) -> int:
        """Where the dotted name that ends at i begins."""
        while self.at(i - 1) in (".", "?.") and self.word(i - 2):
            i -= 2
        return i

    def params(self, i: int) -> str:
        return _spaces(self.source[self.end[i] : self.start[self.closing[i]]])


def _scan(source: str, out: Structure, language: str) -> None:
    """Walks over the tokens; a definition's scope lasts from its name to the end of its body."""
    tokens = _Tokens(source, language)
    step = _Java(tokens, out) if language == "java" else _JavaScript(tokens, out)
    for i, t in enumerate(tokens.text):
        while step.ends and i > step.ends[-1]:
            step.ends.pop()
            out.leave()
        while step.open and i >= tokens.close(step.open[-1]):
            step.open.pop()
        step.visit(i, t)
        if t in ("(", "[", "{"):
            step.open.append(i)


class _Walk:
    def __init__(self, tokens: _Tokens, out: Structure) -> None:
        self.tokens, self.out = tokens, out
        self.ends: list[int] = []  # last tokens of the scopes that are open
        self.open: list[int] = []  # brackets that are open
        self.bodies: dict[int, tuple[str, str]] = {}  # bracket of a type's body: kind and name of the type
        self.names: set[int] = set()  # names that are no calls

    def define(self, kind: str, name: str, params: str, end: int) -> None:
        self.out.define(kind, name, params)
        self.ends.append(end)

    def inside(self) -> tuple[str, str] | None:
        """The type in whose body this token is, with no other bracket between."""
        return self.bodies.get(self.open[-1]) if self.open else None


class _JavaScript(_Walk):
    def _declared(self, i: int) -> bool:
        before = self.tokens.at(i - 1)
        return before not in _EXPECT and before not in (".", "?.")

    def visit(self, i: int, t: str) -> None:
        k = self.tokens
        before, after = k.at(i - 1), k.at(i + 1)
        member = before in (".", "?.")
        if t == "class" and k.word(i) and not member and after not in (":", "("):
            body = k.first(i + 1, "{;")
            named = k.word(i + 1) and after != "extends"
            self.bodies[body] = ("class", after if named else "")
            if named and self._declared(i):
                self.define("class", after, "", k.close(body))
        elif t == "function" and k.word(i) and not member:
            name = i + 1 + (after == "*")
            self.names.update((i, name))
            if name == i + 1 and k.word(name) and name + 1 in k.closing and self._declared(i - (before == "async")):
                self.define("function", after, k.params(name + 1), k.close(k.first(name + 2, "{;")))
        elif i not in self.names and (k.word(i) or t in ('"', "]")):
            opened = i + 1 + (after == "?.")
            if k.at(opened) == "(" and opened in k.closing:
                self._named(i, t, before, member, opened)
            elif k.at(opened) == "`" and k.word(i) and (member or t not in _JS_WORDS):
                self.out.call(t)

    def _named(self, i: int, t: str, before: str, member: bool, opened: int) -> None:
        k = self.tokens
        end = k.closing[opened]
        first = i if t != "]" else next((a for a, b in k.closing.items() if b == i), i)
        led = k.at(first - 1) in ("{", ",", "*", "get", "set", "async", "static")
        in_braces = bool(self.open) and k.at(self.open[-1]) == "{"
        control = t in ("if", "for", "while", "switch", "catch", "with") or t == "await" and before == "for"
        if k.at(end + 1) == "{" and not member and opened == i + 1 and in_braces and (led or self.inside()) and (not control or led and self.inside()):
            self.define("method", k.source[k.start[first] : k.end[i]], k.params(opened), k.close(end + 1))
        elif k.word(i) and k.at(k.dotted(i) - 1) != "new" and (member or t not in _JS_WORDS):
            loop = t == "of" and (k.word(i - 1) or before in ("]", "}")) and before not in _EXPECT
            if not loop and not (t == "async" and k.at(end + 1) == "=>"):
                self.out.call(t)


class _Java(_Walk):
    def __init__(self, tokens: _Tokens, out: Structure) -> None:
        super().__init__(tokens, out)
        self.valued: dict[int, bool] = {}  # by body: whether a field's value has begun

    def visit(self, i: int, t: str) -> None:
        k = self.tokens
        before, after, body = k.at(i - 1), k.at(i + 1), self.inside()
        if body and t in ("=", ";", "}"):
            self.valued[self.open[-1]] = t == "="
        if not k.word(i):
            return
        if t in ("class", "interface", "enum", "record") and before != "." and k.word(i + 1) and (t != "record" or k.at(i + 2) in ("(", "<")):
            opened = k.first(i + 1, "{;")
            self.bodies[opened] = ("annotation" if before == "@" else t, after)
            self.names.add(i + 1)
            if t == "class":
                self.define("class", after, "", k.close(opened))
        elif body and body[0] == "enum" and after == "{" and before in ("{", ","):
            self.bodies[i + 1] = ("constant", t)
        elif after == "(" and i + 1 in k.closing and i not in self.names:
            self._named(i, t, before, body)

    def _named(self, i: int, t: str, before: str, body: tuple[str, str] | None) -> None:
        k = self.tokens
        end, start = k.closing[i + 1], k.dotted(i)
        if k.at(start - 1) == "new":
            self.bodies[end + 1] = ("anonymous", "")  # only looked up if a bracket is there
        elif k.at(start - 1) == "@" or t in _JAVA_WORDS:
            return
        elif body is None or before == "." or self.valued.get(self.open[-1]):
            self.out.call(t)
        elif body[0] == "annotation":
            return
        elif before in (">", "]") or k.word(i - 1) and before not in _MODIFIERS and k.at(k.dotted(i - 1) - 1) != "@":
            last = k.first(end + 1, "{;")
            self.define("method", t, k.params(i + 1), k.close(last) if k.at(last) == "{" else last)
        elif body[0] == "enum" and t != body[1]:
            self.bodies[end + 1] = ("constant", t)


def _error(lines: list[str]) -> SyntaxError | None:
    try:
        ast.parse("\n".join(lines))
    except SyntaxError as e:
        return e
    return None


def _make_plain(lines: list[str], at: int, first: int, e: SyntaxError) -> bool:
    """Put a plain line in place of the one with the error; False if there is none with text from `first` on."""
    while at > first and not lines[at].strip():
        at -= 1  # an error at the end belongs to the last line with text
    line = lines[at]
    if not line.strip():
        return False
    indent = line[: len(line) - len(line.lstrip())]
    plain = f"{indent}if True:" if line.rstrip().endswith(":") else f"{indent}pass"
    lines[at] = "" if line == plain or isinstance(e, IndentationError) and "unindent" in str(e) else plain
    return True


def _mend(lines: list[str]) -> None:
    """Make the lines with errors plain, a few statements of the outermost level at a time, so a file of many such lines takes linear time."""
    tops = [i for i, x in enumerate(lines) if x[:1].strip() and not x.startswith((")", "]", "}", "#", "elif", "else", "except", "finally"))] + [len(lines)]
    last, at, width = len(tops) - 1, 0, 1
    while at < last:
        end = min(at + width, last)
        e = _error(lines[tops[at] : tops[end]])
        if e is None:
            at, width = end, 2 * width
            continue
        line = tops[at] + min(max((e.lineno or 1) - 1, 0), tops[end] - tops[at] - 1)
        top = bisect_right(tops, line) - 1
        if top > at and _error(lines[tops[at] : tops[top]]) is None:
            at, width = top, 1
        elif end < last and ("never closed" in str(e) or "unterminated triple" in str(e)):
            width = 2 * (end - at)  # it may be closed later
        elif _make_plain(lines, line, tops[at], e):
            width = 1
        else:
            return


def parse_python(text: str) -> ast.Module:
    """The syntax tree; a line that can't be parsed is left out (a block's head becomes a plain one), the rest stays."""
    lines = text.split("\n")
    try:
        return ast.parse(text)
    except SyntaxError:
        _mend(lines)
    for _ in range(2 * len(lines) + 1):  # what spans statements of the outermost level, such as a try without its end, is left
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            if not _make_plain(lines, min(max((e.lineno or 1) - 1, 0), len(lines) - 1), 0, e):
                break
    return ast.Module([], [])


def extract_code(path: str, text: str, languages: tuple[str, ...] = ("python", "javascript", "java")) -> tuple[list[dict], list[dict]]:
    """(triples, concepts) of a source file; a disabled language gives none, a line with a syntax error is left out."""
    suffix = path.rsplit(".", 1)[-1].lower()
    language = CODE_FORMATS.get("." + suffix)
    if language not in languages:
        return [], []
    out = Structure(re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1]), suffix)
    if language == "python":
        try:
            _Python(out, text).visit(parse_python(text))
        except (ValueError, RecursionError):
            return [], []
    else:
        _scan(text, out, language)
    triples = [{"head": h, "relation": r, "tail": t, "confidence": "EXTRACTED", "source_file": path, "track": "code", "chunk_index": None} for h, r, t in out.triples]
    concepts = [{"name": n, "description": d, "source_file": path, "confidence": "EXTRACTED", "node_type": k, "extra": {}} for n, (k, d) in out.about.items()]
    return triples, concepts


def code_track(documents: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """documents (path, text) to one row each: source_file, triples, concepts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [extract_code(p, t or "", languages) for p, t in zip(frame["path"], frame["text"], strict=True)]
            yield pd.DataFrame({"source_file": frame["path"], "triples": [x for x, _ in got], "concepts": [x for _, x in got], "failed": False})

    return spread(documents.filter(F.col("suffix").isin(*CODE_FORMATS)).select("path", "text")).mapInPandas(run, EXTRACTED)
