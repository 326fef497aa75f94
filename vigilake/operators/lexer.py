"""Tokens, functions, classes and calls of source texts in languages with braces, without a grammar.

A text becomes tokens (comments, strings and, in PHP, everything outside its tags are left out of them), brackets are
matched, and a few shapes of tokens tell declarations and calls. That is an approximation: macros, generics in calls and
code that does not balance its brackets may be read differently than by a parser. Nothing raises: brackets that do not
match are closed at the end of the text. Time is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

LANGUAGES = ("javascript", "java", "go", "php", "cpp")
_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"""\"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_COMMENT = {
    "cpp": _C_COMMENTS + r"|^[ \t]*\#(?:\\\n|[^\n])*",
    "php": r"/\*.*?(?:\*/|\Z)|(?://|\#(?!\[))(?:(?!\?>)[^\n])*",
}
_STRING = {
    "javascript": _QUOTED + r"|`(?:\\.|[^`\\])*`?",
    "java": r'"""(?:\\.|[^\\])*?(?:"""|\Z)|' + _QUOTED,
    "go": _QUOTED + r"|`[^`]*`?",
    "php": r"""\"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?""",
    "cpp": r'R"(?P<fence>[^(\s"]{0,16})\(.*?\)(?P=fence)"|' + _QUOTED,
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/\w*")
_NOT_NAMES = frozenset(
    ["if", "for", "while", "switch", "catch", "return", "new", "function", "func", "sizeof", "typeof", "throw", "do", "else", "case", "with", "synchronized", "try", "await", "yield", "delete", "in", "of"]
    + ["instanceof", "class", "this", "super", "defer", "go", "range", "select", "var", "let", "const", "import", "package", "elseif", "foreach", "echo", "print", "use", "static_assert", "alignof", "decltype", "operator"]
)
_MODIFIERS = frozenset(["public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "sealed", "transient", "volatile", "async", "get", "set", "inline", "virtual", "explicit", "constexpr", "extern", "readonly"])
_CLOSES = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str  # id, str, num or op
    text: str
    line: int
    start: int
    end: int


class Call(NamedTuple):
    called: str
    enclosing: str | None
    enclosing_line: int
    line_start: int
    line_end: int


class Chunk(NamedTuple):
    kind: str  # function, method or class
    name: str
    parent: str | None
    signature: str
    line_start: int
    line_end: int
    body: str


@dataclass
class _Shape:
    """A declaration: its tokens from first to last, and what it is for."""

    kind: str | None  # of its chunk; None: it is none
    name: str
    first: int
    last: int
    brace: int | None  # the token that opens its braces
    encloses: bool  # calls inside are its
    braces: bool  # its braces alone are its chunk's body, else all of it


@cache
def _master(language: str) -> re.Pattern:
    name = r"\$?[A-Za-z_]\w*" if language == "php" else r"[#@]?[A-Za-z_$][\w$]*" if language == "javascript" else r"[^\W\d]\w*"
    return re.compile(
        rf"(?P<skip>\s+|{_COMMENT.get(language, _C_COMMENTS)})|(?P<str>{_STRING[language]})|(?P<num>\d[\w.]*)|(?P<id>{name})|(?P<op>=>|->|::|\?\.|\?->|:=|[-+*/%<>=!&|]=|&&|\|\||.)", re.S | re.M
    )


def tokens(text: str, language: str) -> list[Token]:
    if language == "php":
        text = _only_php(text)
    master, out, at, line, n = _master(language), [], 0, 1, len(text)
    while at < n:
        m = None
        if language == "javascript" and text[at] == "/" and text[at : at + 2] not in ("//", "/*") and _may_be_regex(out):
            m = _REGEX.match(text, at)
        kind = "str"
        if m is None:
            m = master.match(text, at)
            kind = m.lastgroup if m.lastgroup != "fence" else "str"
        if kind != "skip":
            out.append(Token(kind, m[0], line, at, m.end()))
        line += m[0].count("\n")
        at = m.end()
    return out


def _only_php(text: str) -> str:
    """The text with everything outside of <?php ?> blanked, line ends kept."""
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    out, at = [], 0
    for m in re.finditer(r"<\?(?:php\b|=)?(.*?)(?:\?>|\Z)", text, re.S | re.I):
        out += [blank(text[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join(out) + blank(text[at:])


def _may_be_regex(seen: list[Token]) -> bool:
    return not seen or (seen[-1].kind == "op" and seen[-1].text not in ")]}") or seen[-1].text in ("return", "typeof", "case", "in", "of")


class Source:
    """A text with its tokens and what is found in them."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.tokens = text, language, tokens(text, language)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.inside: list[int] = []  # the innermost open bracket around each token, or -1
        held: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in ")]}":
                while held and _CLOSES[self.tokens[held[-1]].text] != t.text and t.text == "}":
                    self.close[held.pop()] = i
                if held and _CLOSES[self.tokens[held[-1]].text] == t.text:
                    self.close[held[-1]] = i
                    self.open[i] = held.pop()
            self.inside.append(held[-1] if held else -1)
            if t.kind == "op" and t.text in "([{":
                held.append(i)
        for i in held:
            self.close[i] = len(self.tokens) - 1
        self.names: set[int] = set()  # tokens that name a declaration
        self.shapes = sorted(getattr(self, f"_{language}")(), key=lambda s: (s.first, -s.last))

    # what stands at a place
    def t(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != "str" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id"

    def _after_parameters(self, i: int) -> int | None:
        """The token after the brackets that open at i."""
        return self.close[i] + 1 if self.t(i) == "(" and i in self.close else None

    def _first_brace(self, i: int, stops: str = ";") -> int | None:
        """The next { at this depth, before any of the stops."""
        while i < len(self.tokens):
            x = self.t(i)
            if x == "{":
                return i
            if x and (x in stops or x in ")]}"):
                return None
            i = self.close[i] + 1 if x in ("(", "[") and i in self.close else i + 1
        return None

    def _with_modifiers(self, i: int) -> int:
        """Back from a token over modifiers and annotations."""
        while i > 0:
            if self.t(i - 1) in _MODIFIERS or self.t(i - 1) == "*" and self.language == "javascript":
                i -= 1
            elif self.is_name(i - 1) and self.t(i - 2) == "@":
                i -= 2
            elif self.t(i - 1) == ")" and (k := self.open.get(i - 1)) is not None and self.is_name(k - 1) and self.t(k - 2) == "@":
                i = k - 2
            else:
                break
        return i

    def _before_type(self, i: int) -> int:
        """Back from a name over the type before it: names, dots, <...>, [], *, &, ::."""
        depth = 0
        while i > 0:
            x = self.t(i - 1)
            if x in (">", ">>"):
                depth += len(x)
            elif x == "<":
                depth -= 1
            elif depth == 0 and not (self.is_name(i - 1) and x not in _NOT_NAMES) and x not in (".", "[", "]", "*", "&", "::", "?"):
                break
            elif x in (";", "{", "}"):
                break
            i -= 1
        return i

    def _declared(self, kind: str | None, name: int | str, first: int, brace: int | None, last: int | None = None, encloses: bool = True, braces: bool = True) -> _Shape:
        if isinstance(name, int):
            self.names.add(name)
            name = self.t(name)
        end = self.close.get(brace, len(self.tokens) - 1) if brace is not None else last
        return _Shape(kind, name, first, end, brace, encloses, braces and brace is not None)

    # declarations by language
    def _classes(self, words: dict[str, str | None], braces: bool = False) -> list[_Shape]:
        """words: the kind of chunk that each class-like keyword gives. braces: a class's body is its braces alone."""
        out = []
        for i in range(len(self.tokens)):
            if self.t(i) in words and self.t(i - 1) not in (".", "::", "->") and self.is_name(i + 1) and (brace := self._first_brace(i + 2, ";=(")) is not None:
                out.append(self._declared(words[self.t(i)], i + 1, self._with_modifiers(i), brace, encloses=False, braces=braces and self.t(i) == "class"))
        return out

    def _javascript(self) -> list[_Shape]:
        out = self._classes({"class": "class"}, braces=True)
        for i, token in enumerate(self.tokens):
            x = self.t(i)
            if x == "function":
                name = i + 1
                if self.is_name(name) and (after := self._after_parameters(name + 1)) is not None and self.t(after) == "{":
                    first = i - 1 if self.t(i - 1) == "async" else i
                    declares = self.t(first - 1) in ("", ";", "}", "{", ")", "export", "default")
                    out.append(self._declared("function" if declares else None, name, first, after, encloses=declares, braces=False))
            elif x == "=>":
                out.append(self._arrow(i))
            elif token.kind == "id" and x not in _NOT_NAMES and self.t(i - 1) not in ("function", "new", ".", "?.", "=>") and not (self.t(i - 1) == "*" and self.t(i - 2) == "function"):
                if (after := self._after_parameters(i + 1)) is not None and self.t(after) == "{" and self.inside[i] >= 0 and self.t(self.inside[i]) == "{":
                    out.append(self._declared("method", i, self._with_modifiers(i), after, braces=False))
        return out

    def _arrow(self, i: int) -> _Shape:
        first = self.open.get(i - 1, i - 1) if self.t(i - 1) == ")" else max(i - 1, 0)
        name = self.t(first) if self.is_name(first) else "<unknown>"
        if self.t(first - 1) == "async":
            first -= 1
        if self.t(i + 1) == "{":
            return self._declared("function", name, first, i + 1, encloses=False, braces=False)
        last, depth_line = i + 1, self.tokens[i].line
        while last < len(self.tokens) and self.t(last) not in (",", ";", ")", "]", "}"):
            if self.tokens[last].line > depth_line and self.t(last) not in (".", "?", ":", "&&", "||", "+") and last > i + 1:
                break
            last = self.close.get(last, last)
            depth_line = self.tokens[last].line
            last += 1
        return self._declared("function", name, first, None, max(i, last - 1), encloses=False)

    def _java(self) -> list[_Shape]:
        out = self._classes({"class": "class", "interface": "function", "enum": None, "record": None}, braces=True)
        bodies = {s.brace: s.name for s in out}
        for i, token in enumerate(self.tokens):
            if self.t(i) == "->" and i > 0:
                bare = self.is_name(i - 1)
                first = i - 1 if bare else self.open.get(i - 1, i)
                brace = i + 1 if self.t(i + 1) == "{" else None
                out.append(self._declared(None, self.t(i - 1) if bare else "<anonymous>", first, brace, None if brace else self._expression_end(i + 1)))
            if token.kind != "id" or self.inside[i] not in bodies or self.t(i) in _NOT_NAMES or (after := self._after_parameters(i + 1)) is None:
                continue
            makes = self.t(i) == bodies[self.inside[i]]
            if not makes and not (self.is_name(i - 1) and self.t(i - 1) not in _NOT_NAMES or self.t(i - 1) in (">", "]", ">>")):
                continue
            while after < len(self.tokens) and self.t(after) not in ("{", ";", "=", "}"):
                after += 1
            brace = after if self.t(after) == "{" else None
            if brace is not None or self.t(after) == ";" and not makes:
                out.append(self._declared("method", i, self._with_modifiers(self._before_type(i)), brace, after, braces=not makes))
        return out

    def _expression_end(self, i: int) -> int:
        while i < len(self.tokens) and self.t(i) not in (",", ";", ")", "]", "}"):
            i = self.close.get(i, i) + 1
        return max(0, i - 1)

    def _go(self) -> list[_Shape]:
        out = []
        for i in range(len(self.tokens)):
            if self.t(i) == "func":
                method = self.t(i + 1) == "(" and self.is_name(j := self.close.get(i + 1, i) + 1) and self.t(j + 1) == "("
                name = j if method else i + 1 if self.is_name(i + 1) else None
                after = self._after_parameters((name if name is not None else i) + 1)
                brace = self._first_brace(after, ";,=") if after is not None else None
                while brace is not None and self.t(brace - 1) in ("interface", "struct") and brace in self.close:  # a result type
                    brace = self._first_brace(self.close[brace] + 1, ";,=")
                if brace is not None and name is not None:
                    out.append(self._declared("method" if method else "function", name, i, brace))
                elif brace is not None:
                    out.append(self._declared(None, "<anonymous>", i, brace))
            elif self.t(i) == "type" and self.is_name(i + 1) and self.t(i + 2) in ("struct", "interface") and self.t(i + 3) == "{":
                out.append(self._declared("function", i + 1, i, None, self.close.get(i + 3, len(self.tokens) - 1), encloses=False))
        return out

    def _php(self) -> list[_Shape]:
        out = self._classes({"class": "class", "interface": "function", "trait": None})
        bodies = {s.brace for s in out}
        for i in range(len(self.tokens)):
            if self.t(i) != "function":
                continue
            name = i + 2 if self.t(i + 1) == "&" else i + 1
            if not self.is_name(name) or (after := self._after_parameters(name + 1)) is None:
                continue
            brace = self._first_brace(after)
            method = self.inside[i] in bodies
            if brace is not None or method:
                out.append(self._declared("method" if method else "function", name, self._with_modifiers(i) if method else i, brace, after))
        return out

    def _cpp(self) -> list[_Shape]:
        out = self._classes({"class": "class", "struct": "function"})
        for i, token in enumerate(self.tokens):
            if token.kind != "id" or self.t(i) in _NOT_NAMES or (after := self._after_parameters(i + 1)) is None or self.t(i - 1) in (".", "->", "=", "return", "new", ","):
                continue
            if self.t(i - 1) == ":" and self.t(i - 2) == ")":  # a member that a constructor sets
                continue
            around = self.inside[i]
            if around >= 0 and (self.t(around) != "{" or any(s.encloses and s.brace <= around <= s.last for s in out[-1:])):
                continue
            while self.t(after) in ("const", "noexcept", "override", "final", "&", "&&"):
                after += 1
            if self.t(after) == ":" or self.t(after) == "->":
                brace = self._first_brace(after + 1, ";")
            else:
                brace = after if self.t(after) == "{" else None
            if brace is not None:
                out.append(self._declared("function", i, self._with_modifiers(self._before_type(i)), brace))
        return out

    # what is asked for
    def functions(self) -> list[tuple[str, int, int, int]]:
        """Functions whose calls are theirs: name, line, first and last token."""
        return [(s.name, self.tokens[s.first].line, s.first, s.last) for s in self.shapes if s.encloses]

    def calls(self) -> list[Call]:
        """Calls of names, in order, with the innermost function around each."""
        functions, out = self.functions(), []
        for i, name, first, last in self.placed_calls():
            around = [f for f in functions if f[2] <= i <= f[3]]
            inner = min(around, key=lambda f: f[3] - f[2]) if around else (None, 0)
            out.append(Call(name, inner[0], inner[1], first, last))
        return out

    def placed_calls(self) -> list[tuple[int, str, int, int]]:
        """Token, name, first and last line of calls of names, in order. A member's name counts; of a Java member of a plain name that name does; of what a call returns, that call's name."""
        out: list[tuple[int, str, int, int]] = []
        named: dict[int, str] = {}  # by the bracket that opens the arguments
        for i in range(len(self.tokens)):
            if self.t(i) != "(":
                continue
            if self.language != "java" and self.t(i - 1) == ")" and self.open.get(i - 1) in named:
                name, first = named[self.open[i - 1]], self._chain_start(self.open[i - 1] - 1)
            elif not self.is_name(i - 1) or i - 1 in self.names or self.t(i - 1) in _NOT_NAMES or self.t(i - 2) in ("new", "@", "func"):
                continue
            else:
                name, first = self.t(i - 1), self._chain_start(i - 1)
                if self.language == "cpp" and self.t(i - 2) in (".", "->", "::"):
                    continue
                if self.language == "java" and self.t(i - 2) == "." and self.is_name(i - 3) and self.t(i - 3) not in ("this", "super") and self.t(i - 4) != ".":
                    name = self.t(i - 3)
            named[i] = name
            out.append((i, name, self.tokens[first].line, self.tokens[self.close.get(i, i)].line))
        return out

    def _chain_start(self, i: int) -> int:
        """The first token of the member chain that ends in the name at i."""
        while i > 1 and self.t(i - 1) in (".", "?.", "->", "::"):
            i -= 2
            while self.t(i) in (")", "]") and i in self.open:
                i = self.open[i]
                if i > 0 and (self.is_name(i - 1) and self.t(i - 1) not in _NOT_NAMES or self.t(i - 1) in (")", "]")):
                    i -= 1
                else:
                    return i
        return i

    def chunks(self) -> list[Chunk]:
        """Functions, methods and classes, nested ones too, with the class around each."""
        out = []
        for s in self.shapes:
            if s.kind is None:
                continue
            whole = self.text[self.tokens[s.first].start : self.tokens[s.last].end]
            body = self.text[self.tokens[s.brace].start : self.tokens[s.last].end] if s.braces else whole
            around = [c for c in self.shapes if c.kind == "class" and c is not s and c.first <= s.first and s.last <= c.last]
            parent = min(around, key=lambda c: c.last - c.first).name if around else None
            out.append(Chunk(s.kind, s.name, parent, whole.split("\n")[0].strip(), self.tokens[s.first].line, self.tokens[s.last].line, body))
        return out
