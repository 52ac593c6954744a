"""Tokens of JavaScript, TypeScript and JSX: a stack of modes tells templates, regular expressions, elements and type arguments
from plain code, so that what stands in `${}` or `{}` is code again and what stands in text is not."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, text, number, sign, regex, template (a part of one) or markup
    raw: str
    start: int
    end: int


_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_NAME = re.compile(r"#?[^\W\d][\w$]*|[$#][\w$]*|\\u[0-9A-Fa-f{}]+[\w$]*")
_TEXT = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_NUMBER = re.compile(r"\.?\d(?:[eE][+-]|[\w.])*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_SIGN = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[^\w\s]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_MARKUP_TEXT = re.compile(r"[^<{]+")
_BEFORE = rf"(?:(?=[\s/#]){_SPACE.pattern})?+"


def _plain(signs: str) -> tuple[re.Pattern, re.Pattern]:
    """What needs no look at modes or at the token before: names, texts, numbers and all signs but these, with the space before
    each; and runs of these, with the space behind."""
    sign = rf"(?![{signs}])(?:{_SIGN.pattern})"
    one = re.compile(rf"({_BEFORE})(?:({_NAME.pattern})|({_TEXT.pattern})|({_NUMBER.pattern})|({sign}))", re.S)
    return one, re.compile(rf"((?:{_BEFORE}(?:{_NAME.pattern}|{_TEXT.pattern}|{_NUMBER.pattern}|{sign}))*+){_BEFORE}", re.S)


#: Within templates and elements a brace may end the mode. Outside of them brackets are plain too, and `<` where no elements stand.
_INSIDE, _OUTSIDE, _WITHOUT_MARKUP = _plain("(){}/<`"), _plain("/<`"), _plain("/`")
_BRACKETS = frozenset("(){}")
_TAG = re.compile(r"<(?:(?P<name>[A-Za-z_$][\w$.:-]*)|(?=>))")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:-]*|=|\"[^\"]*\"|'[^']*'")
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|>\s*\()")
#: After these words an expression begins, so that a slash begins a regular expression and `<` an element.
_BEFORE_EXPRESSION = frozenset("return typeof case do else in instanceof new void delete throw yield await of default extends".split())
#: A bracket after these words closes a condition, after which a statement begins.
_CONDITIONS = frozenset("if while for with".split())


def _begins_expression(last: Token | None, closes_condition: bool) -> bool:
    if last is None:
        return True
    if last.kind == "name":
        return last.raw in _BEFORE_EXPRESSION
    if last.kind == "sign":
        return closes_condition if last.raw == ")" else last.raw not in ("]", "}")
    return last.kind == "template" and not last.raw.endswith("`")


class Lexer:
    """Reads one file. `markup` says whether elements may stand in it (JSX, TSX and plain JavaScript)."""

    def __init__(self, text: str, markup: bool):
        self.text, self.markup, self.at, self.out = text, markup, 0, []
        self.modes: list[list] = [["code", 0]]  # code has the number of open braces; element and tag the depth of elements
        self.brackets: list[bool] = []  # for each open round bracket, whether it is a condition's
        self.condition = False
        self.before_brace: list[bool] = []  # for each open brace, whether a statement follows its end

    def add(self, kind: str, end: int) -> None:
        self.out.append(Token(kind, self.text[self.at : end], self.at, end))
        self.at = end

    def run(self) -> list[Token]:
        while self.at < len(self.text):
            if self.modes[-1][0] == "code":
                self.plain()
                if self.at == len(self.text):
                    break
            at, mode = self.at, self.modes[-1]
            getattr(self, mode[0])()
            if self.at == at and self.modes[-1] is mode:
                self.at += 1  # nothing fits: such a character is passed over
        return self.out

    def plain(self) -> None:
        """A run of tokens of plain code, in one pass of one expression."""
        at, add, new = self.at, self.out.append, tuple.__new__
        one, run = _INSIDE if len(self.modes) > 1 else _OUTSIDE if self.markup else _WITHOUT_MARKUP
        run = run.match(self.text, at)
        for space, name, text, number, sign in one.findall(self.text, at, run.end(1)):
            if space:
                at += len(space)
            if name:
                end = at + len(name)
                add(new(Token, ("name", name, at, end)))
            elif sign:
                if sign in _BRACKETS:
                    self.bracket(sign)
                end = at + len(sign)
                add(new(Token, ("sign", sign, at, end)))
            else:
                end = at + len(text or number)
                add(new(Token, ("text" if text else "number", text or number, at, end)))
            at = end
        self.at = run.end()

    def expression_begins(self) -> bool:
        last = self.out[-1] if self.out else None
        if last and last.kind == "sign" and last.raw == "}":
            return self.statement_follows
        return _begins_expression(last, self.condition)

    statement_follows = True

    def code(self) -> None:
        t, at = self.text, self.at
        if m := _SPACE.match(t, at):
            self.at = m.end()
            return
        c = t[at]
        if c == "`":
            self.add("template", at + 1)
            self.modes.append(["template"])
        elif c in "\"'":
            self.add("text", _TEXT.match(t, at).end())
        elif m := _NUMBER.match(t, at):
            self.add("number", m.end())
        elif m := _NAME.match(t, at):
            self.add("name", m.end())
        elif c == "/" and self.expression_begins() and (m := _REGEX.match(t, at)):
            self.add("regex", m.end())
        elif c == "<" and self.markup and self.expression_begins() and _TAG.match(t, at) and not _TYPE_PARAMETERS.match(t, at):
            self.modes.append(["tag", 0])
        else:
            self.sign(_SIGN.match(t, at))

    def sign(self, m) -> None:
        if not m:
            self.at += 1
            return
        raw = m[0]
        if raw in _BRACKETS:
            self.bracket(raw)
            if self.modes[-1][1] < 0 and len(self.modes) > 1:  # the end of ${} or {} in a text
                self.modes.pop()
                inside = self.modes[-1][0]
                self.add("template" if inside == "template" else "markup", m.end())
                return
        self.add("sign", m.end())

    def bracket(self, raw: str) -> None:
        """What a bracket, which is not among the tokens yet, says of what follows it or its end."""
        if raw == "(":
            last = self.out[-1] if self.out else None
            self.brackets.append(last is not None and last[1] in _CONDITIONS and last[0] == "name")
        elif raw == ")":
            self.condition = self.brackets.pop() if self.brackets else False
        elif raw == "{":
            last = self.out[-1] if self.out else None
            self.modes[-1][1] += 1
            self.before_brace.append(last is None or last[0] == "sign" and last[1] in (")", ";", "{", "}", "=>") or last[0] == "name" and last[1] in ("else", "do", "try", "finally"))
        else:
            self.statement_follows = self.before_brace.pop() if self.before_brace else True
            self.modes[-1][1] -= 1

    def template(self) -> None:
        end = _TEMPLATE.match(self.text, self.at).end()
        if self.text.startswith("${", end):
            self.add("template", end + 2)
            self.modes.append(["code", 0])
        else:
            self.add("template", min(end + 1, len(self.text)))
            self.modes.pop()

    def tag(self) -> None:
        """From `<` to the `>` that ends an opening, closing or empty tag; the mode's number is that of elements around."""
        t, mode = self.text, self.modes[-1]
        if t[self.at] == "<":
            closing = t.startswith("</", self.at)
            mode.append(closing)
            self.add("markup", self.at + 1 + closing)
            return
        if m := re.compile(r"\s+").match(t, self.at):
            self.at = m.end()
        elif t.startswith("/>", self.at):
            self.add("markup", self.at + 2)
            self.after_tag(0)
        elif t[self.at] == ">":
            self.add("markup", self.at + 1)
            self.after_tag(-1 if mode[2] else 1)
        elif t[self.at] == "{":
            self.add("markup", self.at + 1)
            self.modes.append(["code", 0])
        elif m := _ATTRIBUTE.match(t, self.at):
            self.add("markup", m.end())
        else:
            self.at += 1

    def after_tag(self, change: int) -> None:
        depth = self.modes.pop()[1] + change
        if depth > 0:
            self.modes.append(["element", depth])
        else:
            self.statement_follows = False

    def element(self) -> None:
        """The text between tags."""
        t = self.text
        if m := _MARKUP_TEXT.match(t, self.at):
            self.add("markup", m.end())
        elif t[self.at] == "{":
            self.add("markup", self.at + 1)
            self.modes.append(["code", 0])
        else:
            self.modes.append(["tag", self.modes.pop()[1]])


_ANGLE = re.compile(r"[\w$.\s,\[\]|&'\"?:{}()=>-]*>")


def joined(tokens: list[Token]) -> list[Token]:
    """Templates without `${}` as one text, and calls without their type arguments, so that name and bracket stand together."""
    out: list[Token] = []
    at = 0
    for k in [k for k, t in enumerate(tokens) if t[1] == "`" or t[1] == "<"]:
        if k < at:
            continue
        out += tokens[at:k]
        a, at = tokens[k], k
        b = tokens[k + 1] if k + 1 < len(tokens) else None
        if a.kind == "template" and b and b.kind == "template" and b.raw.endswith("`"):
            out.append(Token("text", a.raw + b.raw, a.start, b.end))
            at = k + 2
        elif a.kind == "sign" and out and out[-1].kind == "name" and (end := _type_arguments(tokens, k)):
            at = end
    return out + tokens[at:]


def _type_arguments(tokens: list[Token], k: int) -> int | None:
    """Where the bracket after type arguments is, if tokens[k] begins some: `<` to `>` with a call behind and no expression within."""
    depth = 0
    for j in range(k, len(tokens)):
        t = tokens[j]
        if t.kind == "sign":
            depth += (t.raw == "<") - (t.raw == ">")
            if depth == 0:
                return j + 1 if j + 1 < len(tokens) and tokens[j + 1].raw == "(" else None
            if t.raw in ("(", ")", ";", "=", "+", "-", "*", "/", "!", "%", "^", "~"):
                return None
        elif t.kind not in ("name", "text", "number"):
            return None
    return None


def tokens(text: str, markup: bool) -> list[Token]:
    found = Lexer(text, markup).run()
    return joined(found) if "`" in text or "<" in text else found
