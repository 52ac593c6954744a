"""HCL files as nested dictionaries and lists. Expressions are parsed with their precedence, so that each is one value; what is
no literal becomes its text, as `${...}`."""

from __future__ import annotations

import re

_SPACE = re.compile(r"(?:[^\S\n]+|#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[^\W\d][\w-]*(?:::[^\W\d][\w-]*)*")
_HEREDOC = re.compile(r"<<([-~]?)([^\W\d][\w-]*)[^\S\n]*\n(.*?)^[^\S\n]*\2[^\S\n]*$", re.S | re.M)
_SIGN = re.compile(r"&&|\|\||==|!=|<=|>=|=>|\.\.\.|.", re.S)
#: Binary operators, the loosest first.
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))
_LEVEL = {operator: level for level, own in enumerate(_LEVELS) for operator in own}
#: All tokens but documents and strings with expressions or escapes, with the space before each; and runs of these.
_SIMPLE_TEXT, _SIMPLE_SIGN = r"\"[^\"\\\n$%]*\"", rf"(?!\"|<<)(?:{_SIGN.pattern})"
_PLAIN = re.compile(rf"(?:{_SPACE.pattern})?+(?:({_NAME.pattern})|(\n)|({_NUMBER.pattern})|({_SIMPLE_TEXT})|({_SIMPLE_SIGN}))", re.S)
_RUN = re.compile(rf"(?:(?:{_SPACE.pattern})?+(?:{_NAME.pattern}|\n|{_NUMBER.pattern}|{_SIMPLE_TEXT}|{_SIMPLE_SIGN}))*+", re.S)
_WORDS = {"true": True, "false": False, "null": None}


class Text(str):
    """The text of an expression that is no literal."""


def _string_end(text: str, at: int) -> int:
    """Behind the quote that ends a string; strings within its `${}` and `%{}` are no end."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == '"':
            return at + 1
        elif text.startswith(("$${", "%%{"), at):
            at += 3
        elif text.startswith(("${", "%{"), at):
            at, depth = at + 2, 1
            while depth and at < len(text):
                if text[at] == '"':
                    at = _string_end(text, at)
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        elif c == "\n":
            break
        else:
            at += 1
    raise ValueError("a string has no end")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        end = _RUN.match(text, at).end()
        out += [("name", name) if name else ("sign", sign) if sign else ("line", line) if line else ("text", plain) if plain else ("number", number) for name, line, number, plain, sign in _PLAIN.findall(text, at, end)]
        at = m.end() if (m := _SPACE.match(text, end)) else end
        if at == len(text):
            break
        if text[at] == '"':
            kind, end = "text", _string_end(text, at)
        elif m := _HEREDOC.match(text, at):
            out.append(("doc", m[3].removesuffix("\n")))
            at = m.end()
            continue
        else:
            kind, end = "sign", _SIGN.match(text, at).end()
        out.append((kind, text[at:end]))
        at = end
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.inside = [*tokens(text), (None, None)], 0, 0

    def _skip(self) -> None:
        while self.tokens[self.at][0] == "line":
            self.at += 1

    def peek(self) -> tuple[str | None, str | None]:
        """The next token; within brackets, ends of lines are none."""
        if self.inside:
            self._skip()
        return self.tokens[self.at]

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        kind, raw = self.peek()
        if kind is None or wanted is not None and (raw != wanted or kind == "text"):
            raise ValueError(f"{wanted or 'a value'} is missing before {raw!r}")
        self.at += 1
        return kind, raw

    def sign(self, *wanted: str) -> bool:
        kind, raw = self.peek()
        return kind == "sign" and raw in wanted

    def file(self) -> dict:
        out = self.body(None)
        if self.peek()[0] is not None:
            raise ValueError(f"{self.tokens[self.at][1]!r} stands outside of all blocks")
        return out

    def body(self, end: str | None) -> dict:
        """Attributes, and lists of blocks by their types, each below its labels."""
        out: dict = {}
        held, self.inside = self.inside, 0
        while True:
            self._skip()
            kind, name = self.tokens[self.at]
            if kind is None or kind == "sign" and name == end:
                break
            self.at += 1
            if kind not in ("name", "text"):
                raise ValueError(f"{name!r} begins no block or attribute")
            if self.tokens[self.at] == ("sign", "="):
                self.at += 1
                out[name.strip('"')] = plain(self.expression())
                continue
            labels = []
            while self.tokens[self.at][0] in ("name", "text"):
                labels.append(self.take()[1].strip('"'))
            self.take("{")
            inner = self.body("}")
            self.take("}")
            for label in reversed(labels):
                inner = {label: inner}
            if not isinstance(out.setdefault(name, []), list):
                raise ValueError(f"{name} is an attribute and a block")
            out[name].append(inner)
        self.inside = held
        return out

    def expression(self):
        first = self.binary(0)
        if not self.sign("?"):
            return first
        self.take()
        self.inside += 1  # branches may stand on lines of their own
        yes = self.expression()
        self.take(":")
        self.inside -= 1
        no = self.expression()
        return Text(f"{shown(first)} ? {shown(yes)} : {shown(no)}")

    def binary(self, level: int):
        """Operators from a level on; each takes what binds closer on its right."""
        left = self.unary()
        while True:
            kind, operator = self.peek()
            own = _LEVEL.get(operator, -1) if kind == "sign" else -1
            if own < level:
                return left
            self.at += 1
            self._skip()
            left = Text(f"{shown(left)} {operator} {shown(self.binary(own + 1))}")

    def unary(self):
        if not self.sign("!", "-"):
            return self.postfix(self.primary())
        operator, value = self.take()[1], self.unary()
        if operator == "-" and type(value) in (int, float):
            return -value
        return Text(operator + shown(value))

    def postfix(self, value):
        while True:
            kind, raw = self.peek()
            if kind != "sign":
                return value
            if raw == ".":
                self.at += 1
                value = Text(f"{shown(value)}.{self.take()[1]}")
            elif raw == "[":
                self.at += 1
                self.inside += 1
                if self.sign("*"):
                    index = self.take()[1]
                else:
                    index = shown(self.expression())
                self.take("]")
                self.inside -= 1
                value = Text(f"{shown(value)}[{index}]")
            else:
                return value

    def primary(self):
        kind, raw = self.take()
        if kind == "number":
            return int(raw) if raw.isdigit() else float(raw)
        if kind == "text":
            return raw[1:-1]
        if kind == "doc":
            return raw
        if kind == "name":
            if self.sign("("):
                return Text(f"{raw}({self.arguments()})")
            return _WORDS[raw] if raw in _WORDS else Text(raw)
        if raw not in ("(", "[", "{"):
            raise ValueError(f"{raw!r} is no value")
        self.inside += 1
        try:
            if raw == "(":
                inner = self.expression()
                self.take(")")
                return Text(f"({shown(inner)})")
            if self.peek() == ("name", "for"):
                return self.comprehension("]" if raw == "[" else "}", raw)
            if raw == "[":
                return self.items("]")
        finally:
            self.inside -= 1
        return self.object()

    def arguments(self) -> str:
        self.take("(")
        self.inside += 1
        out = []
        while not self.sign(")"):
            out.append(shown(self.expression()))
            if self.sign("..."):
                out[-1] += self.take()[1]
            if not self.sign(")"):
                self.take(",")
        self.take(")")
        self.inside -= 1
        return ", ".join(out)

    def items(self, end: str) -> list:
        out = []
        while not self.sign(end):
            out.append(self.expression())
            if not self.sign(end):
                self.take(",")
        self.take(end)
        return out

    def object(self) -> dict:
        """Keys and values, which commas or ends of lines divide."""
        out, held, self.inside = {}, self.inside, 0
        while True:
            self._skip()
            if self.sign("}"):
                break
            key = self.expression()
            if not self.sign("=", ":"):
                raise ValueError(f"a value of {shown(key)} is missing")
            self.take()
            out[key if isinstance(key, str) and not isinstance(key, Text) or isinstance(key, Text) and _NAME.fullmatch(key) else shown(key)] = self.expression()
            if self.sign(","):
                self.take()
        self.take("}")
        self.inside = held
        return {str(k): v for k, v in out.items()}

    def comprehension(self, end: str, opening: str) -> Text:
        """[for k, v in x : value if condition] and {for k, v in x : key => value... if condition}."""
        self.take("for")
        names = [self.take()[1]]
        while self.sign(","):
            self.take()
            names.append(self.take()[1])
        self.take("in")
        source = shown(self.expression())
        self.take(":")
        value = shown(self.expression())
        if self.sign("=>"):
            self.take()
            value += f" => {shown(self.expression())}"
            if self.sign("..."):
                value += self.take()[1]
        if self.peek() == ("name", "if"):
            self.take()
            value += f" if {shown(self.expression())}"
        self.take(end)
        return Text(f"{opening}for {', '.join(names)} in {source} : {value}{end}")


def shown(value) -> str:
    """A value as it stands in an expression."""
    if isinstance(value, Text):
        return value
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, list):
        return f"[{', '.join(map(shown, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k} = {shown(v)}" for k, v in value.items()) + "}"
    return {True: "true", False: "false", None: "null"}[value] if value is None or value is True or value is False else str(value)


def plain(value):
    """Literals as they are, other expressions as `${...}`."""
    if isinstance(value, Text):
        return f"${{{value}}}"
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def parse(text: str) -> dict:
    return Parser(text).file()
