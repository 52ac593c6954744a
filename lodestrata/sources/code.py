"""Calls and imports of Java, JavaScript and TypeScript sources, as rows. What they are bound to is found by joins afterwards."""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import jslex

#: The space before a token, and it as a text, name, number or sign; none of these is at the end.
_TOKEN = re.compile(r"""((?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+)(?:(\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|([A-Za-z_$][\w$]*)|(\d[\w.]*)|(=>|\?\.|.)|\Z)""", re.S)
_NO_CALL = frozenset("if for while switch catch function return typeof await new super synchronized assert do else in of instanceof void delete yield throw case".split())
_OPEN, _CLOSE = "([{", ")]}"
_BRACKETS = frozenset(_OPEN + _CLOSE)
_ENDS = frozenset((";", ",", ")", "}", "]", "const", "let", "var"))
_SIZES = ("modulusLength", "keyLength", "length")


def java_tokens(text: str) -> list[tuple]:
    """In one pass of one expression."""
    out, at = [], 0
    for space, string, name, number, sign in _TOKEN.findall(text):
        at += len(space)
        if raw := name or sign or string or number:
            end = at + len(raw)
            out.append(("name" if name else "sign" if sign else "text" if string else "number", raw, at, end))
            at = end
    return out


class Source:
    """The tokens of a file: kind, text, and where they begin and end."""

    def __init__(self, text: str, language: str = "java", markup: bool = True):
        self.text = text
        if language == "java":
            self.tokens = java_tokens(text)
        else:
            self.tokens = jslex.tokens(text, markup)
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for k, raw in [(k, t[1]) for k, t in enumerate(self.tokens) if t[1] in _BRACKETS and t[0] == "sign"]:
            if raw in _OPEN:
                stack.append(k)
            elif stack:
                self.partner[k] = stack[-1]
                self.partner[stack.pop()] = k

    def word(self, k: int) -> str:
        return self.tokens[k][1] if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k][0] if 0 <= k < len(self.tokens) else ""

    def parts(self, opening: int) -> list[tuple[int, int]]:
        """The ranges of tokens between the commas of a bracket."""
        tokens, partner = self.tokens, self.partner
        end, out, at, k = partner.get(opening, len(tokens)), [], opening + 1, opening + 1
        while k < end:
            if tokens[k][0] == "sign":
                raw = tokens[k][1]
                if raw == ",":
                    out.append((at, k))
                    at = k + 1
                elif raw in _OPEN:
                    k = partner.get(k, k)
            k += 1
        return [x for x in [*out, (at, end)] if x[0] < x[1]]

    def fields(self, opening: int) -> list[tuple[str, int]]:
        """Names of an object's fields and the tokens that are their whole values."""
        return [(self.word(a).strip("\"'"), a + 2) for a, b in self.parts(opening) if self.word(a + 1) == ":" and b == a + 3]

    def first_text(self, opening: int) -> str | None:
        for a, b in self.parts(opening):
            if b == a + 1 and self.kind(a) == "text":
                return self.word(a)[1:-1]
            if self.word(a) == "{":
                for name, k in self.fields(a):
                    if name == "name" and self.kind(k) == "text":
                        return self.word(k)[1:-1]
        return None

    def number(self, k: int) -> int | None:
        try:
            return int(float(self.word(k).replace("_", "").rstrip("lLn"))) if self.kind(k) == "number" else None
        except ValueError:
            return None

    def size(self, opening: int) -> int | None:
        plain = [self.number(a) for a, b in self.parts(opening) if b == a + 1]
        named = [self.number(k) for a, _ in self.parts(opening) if self.word(a) == "{" for name, k in self.fields(a) if name in _SIZES]
        return next((x for x in [*plain, *named] if x is not None), None)

    def receiver(self, dot: int) -> int:
        """Where the expression before a dot begins."""
        k = dot - 1
        while k >= 0:
            while self.word(k) in _CLOSE and self.kind(k) == "sign" and k in self.partner:
                k = self.partner[k] - 1
            if self.kind(k) not in ("name", "text", "regex"):
                return k + 1
            if self.word(k - 1) not in (".", "?."):
                return k
            k -= 2
        return 0

    def module(self, a: int, b: int) -> str | None:
        """The module that an expression requires or imports."""
        for k in range(a, b):
            if self.tokens[k][1] in ("require", "import") and self.word(k + 1) == "(" and (found := self.first_text(k + 1)):
                return found.replace("node:", "")
        return None


def calls(s: Source, names: set[str] | None = None) -> list[tuple]:
    """Line, object, method, first literal text, size, the size that a chained initialize() has, inline module, the call's text.
    If names are given, calls of methods with other names are passed over."""
    text, tokens, out, line, counted = s.text, s.tokens, [], 1, 0
    for k in sorted(p - 1 for p in s.partner if tokens[p][1] == "("):
        if k < 0 or tokens[k][0] != "name" or tokens[k][1] in _NO_CALL or names is not None and tokens[k][1] not in names:
            continue
        before = s.word(k - 1)
        if before in ("new", "function", "class"):
            continue
        end, dotted = s.partner[k + 1], before in (".", "?.")
        begin = s.receiver(k - 1) if dotted else k
        if s.word(begin - 1) == "new":
            begin -= 1
        chained = s.size(end + 3) if s.word(end + 1) == "." and s.word(end + 2) == "initialize" and s.word(end + 3) == "(" else None
        obj = text[tokens[begin][2] : tokens[k - 1][2]].strip() if dotted else ""
        start = tokens[begin][2]
        line, counted = (line + text.count("\n", counted, start), start) if start >= counted else (text.count("\n", 0, start) + 1, start)
        out.append((line, obj, s.word(k), s.first_text(k + 1), s.size(k + 1), chained, s.module(begin, k) if dotted else None, text[s.tokens[begin][2] : s.tokens[end][3]]))
    return out


def java_imports(s: Source) -> list[tuple]:
    """Local name, what it stands for, and the member that a static import names."""
    out = []
    for k in [k for k, t in enumerate(s.tokens) if t[1] == "import" and t[0] == "name"]:
        end = next((j for j in range(k, len(s.tokens)) if s.word(j) == ";"), len(s.tokens))
        names = [s.word(j) for j in range(k + 1, end) if s.word(j) != "."]
        static = names[:1] == ["static"]
        names = names[static:]
        if not names or names[-1] == "*":
            continue
        if static and len(names) > 1:
            out += [(names[-1], ".".join(names[:-1]), names[-1]), (names[-2], ".".join(names[:-1]), None)]
        else:
            out.append((names[-1], ".".join(names), None))
    return out


def bound(imports: list[tuple], calls: list[tuple]) -> Iterator[tuple]:
    """For each call module and member of the import that its object, the object's first name or its method is bound to. Of
    several imports of a name the greatest one holds."""
    held: dict[str, tuple] = {}
    for local, *own in imports:
        held[local] = max(held.get(local, tuple(own)), tuple(own), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    for _, obj, method, *_ in calls:
        found = [held[x] for x in ((obj, obj.split(".", 1)[0]) if obj else (method,)) if x in held]
        yield next((x for x in found if obj or x[1] is not None), (None, None))


def js_imports(s: Source) -> list[tuple]:
    """Local name, module, and the member where the name stands for one."""
    out = []

    tokens = s.tokens

    def named(opening: int, module: str, between: str) -> None:
        out.extend((tokens[b - 1][1], module, tokens[a][1]) for a, b in s.parts(opening) if b - a == 1 or tokens[a + 1][1] == between)

    for k in [k for k, t in enumerate(s.tokens) if t[1] == "import" or t[1] == "="]:
        if s.word(k) == "import" and s.kind(k) == "name" and s.word(k + 1) != "(" and s.word(k - 1) not in (".", "?."):
            end = next((j for j in range(k + 1, len(tokens)) if tokens[j][0] == "text" or tokens[j][1] in (";", "(", "=")), None)
            if end is None or s.kind(end) != "text" or s.word(end - 1) != "from":
                continue
            module, j = s.word(end)[1:-1].replace("node:", ""), k + 1
            while j < end - 1:
                if s.word(j) == "{":
                    named(j, module, "as")
                    j = s.partner.get(j, end)
                elif s.word(j) == "*" and s.word(j + 1) == "as":
                    out.append((s.word(j + 2), module, None))
                    j += 2
                elif s.kind(j) == "name" and s.word(j) != "type":
                    out.append((s.word(j), module, None))
                j += 1
        elif tokens[k][1] == "=" and tokens[k][0] == "sign":
            name = k - 1
            pattern = s.partner.get(name) if s.word(name) == "}" else None
            if pattern is None and s.kind(name) != "name" or s.word((pattern if pattern is not None else name) - 1) not in ("const", "let", "var", ","):
                continue
            end = k + 1
            while end < len(tokens) and (raw := tokens[end][1]) not in _ENDS:
                end = s.partner.get(end, end) + 1 if raw in _OPEN else end + 1
            if module := s.module(k + 1, end):
                named(pattern, module, ":") if pattern is not None else out.append((s.word(name), module, None))
    return out
