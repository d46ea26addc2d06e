"""Statement productions of ECMAScript 2022 over token classes.

A token is its class: a punctuator or keyword stands for itself, ``NAME``, ``NUM``, ``STR``, ``REGEX``, ``PRIV``, ``TPL`` (template without
substitutions), ``TPLH``, ``TPLM``, ``TPLT`` (its parts), ``ERR``. Names that some production asks for by text (async, of, get ...) keep
their text. A class that begins on a new line has ``NL`` (a newline) before it.
"""

from __future__ import annotations

import re
import unicodedata

NL = "\n"
# fixed values: reserved words and contextual words of the language
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
CONTEXTUAL = set("async await of get set static let yield from as target meta".split())
ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
UNARY = set("delete void typeof + - ~ !".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")": "(", "]": "[", "}": "{"}

_TOKEN = re.compile(
    r"(?P<ws>[ \t\v\f\xa0﻿ -  　]+)|(?P<nl>\r\n|[\n\r  ])|(?P<lc>//[^\n\r  ]*)|(?P<bc>/\*[\s\S]*?\*/)"
    r"|(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0\d+|0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$]))"
    r"|(?P<name>\#?(?:[A-Za-z_$]|[^\x00-\x7f\W]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
_ESCAPE = re.compile(r"\\(?:u(?:[0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|x[0-9a-fA-F]{2}|[^ux])", re.S)
_TEMPLATE_ESCAPE = re.compile(r"\\(?:u(?:[0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|x[0-9a-fA-F]{2}|0(?!\d)|[^ux0-9])", re.S)
_BACKSLASH = re.compile(r"\\[\s\S]")
_NAME_ESCAPE = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))")
_DIGITS = re.compile(r"0|[1-9][\d_]*|0\d*[89]\d*")
_LEGACY = re.compile(r"0\d")
_BEFORE_REGEX = set("return typeof case do else in instanceof new void delete throw yield await of".split())
_VALUE_END = {"NAME", "NUM", "STR", "TPL", "TPLT", "REGEX", "PRIV", "]", "this", "super", "null", "true", "false", "++", "--"} | (CONTEXTUAL - {"of", "yield", "await"})


def _escaped(s: str, kind: re.Pattern = _ESCAPE) -> bool:
    """Whether all escapes of a string or template are right."""
    return "\\" not in s or all(kind.match(s, m.start()) for m in _BACKSLASH.finditer(s))


def _number(s: str, after: str) -> bool:
    """A number that begins with 0 and a digit has no separators, and an octal one no fraction; the point after digits belongs to them."""
    if _LEGACY.match(s) and ("_" in s or not re.search("[89]", re.split("[.eE]", s)[0]) and re.search("[.eE]", s)):
        return False
    return after != "." or not _DIGITS.fullmatch(s)


def _name(s: str) -> bool:
    """Escapes and letters beyond ASCII give characters that a name may hold."""
    s = s.lstrip("#")
    if s.isascii() and "\\" not in s:
        return True
    codes = [int(a or b, 16) for a, b in _NAME_ESCAPE.findall(s)]
    if any(c > 0x10FFFF for c in codes):
        return False
    s = _NAME_ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), s)
    kinds = [unicodedata.category(c) for c in s]
    start = s[0] in "$_" or kinds[0][0] == "L" or kinds[0] == "Nl" or s[0].isidentifier()
    return start and all(c in "$\u200c\u200d" or k[0] == "L" or k in ("Nl", "Mn", "Mc", "Nd", "Pc") or f"a{c}".isidentifier() for c, k in zip(s[1:], kinds[1:]))


def _pattern(body: str, flags: str) -> bool:
    """Whether the text between the slashes is a pattern (ECMAScript 2022 with annex B; flag v is read like u, its nested classes are not judged)."""
    uni = "u" in flags or "v" in flags
    if "u" in flags and "v" in flags:
        return False
    if not uni:  # without u a pattern is read by UTF-16 units
        body = "".join(c if c <= "\uffff" else chr(0xD7C0 + (ord(c) >> 10)) + chr(0xDC00 + (ord(c) & 0x3FF)) for c in body)
    n, i = len(body), 0
    capturing = len(re.findall(r"\((?!\?)|\(\?<(?![=!])", re.sub(r"\\[\s\S]|\[(?:[^\]\\]|\\[\s\S])*\]", "", body)))
    names = re.findall(r"\(\?<([^=!>][^>]*)>", re.sub(r"\\[\s\S]|\[(?:[^\]\\]|\\[\s\S])*\]", "", body))
    stack: list[str] = []
    atom = False  # whether a quantifier may follow

    def escape(i: int, inside: bool) -> tuple[int, int | None]:
        """The end of the escape at i and its character (None: a class); -1 if there is none."""
        c = body[i + 1 : i + 2]
        if c == "k" and not inside and (uni or names):
            m = re.compile(r"<([^>]+)>").match(body, i + 2)
            return (m.end(), 0) if m and m.group(1) in names else (-1, 0)
        m = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|c([A-Za-z]))").match(body, i)
        if m:
            return m.end(), int(m.group(1) or m.group(2), 16) if m.group(1) or m.group(2) else ord(m.group(3)) % 32
        if uni:
            m = re.compile(r"\\u\{([0-9a-fA-F]+)\}").match(body, i)
            if m:
                return (m.end(), int(m.group(1), 16)) if int(m.group(1), 16) <= 0x10FFFF else (-1, 0)
            if c in "pP":
                m = re.compile(r"\{\w+(?:=\w+)?\}").match(body, i + 2)
                return (m.end(), None) if m else (-1, 0)
            if c.isdigit():
                m = re.compile(r"\d+").match(body, i + 1)
                if m.group(0) == "0":
                    return m.end(), 0
                return (m.end(), 0) if not inside and c != "0" and int(m.group(0)) <= capturing else (-1, 0)
            if c not in "dDsSwWfnrtvbB^$\\.*+?()[]{}|/" and not (inside and (c == "-" or "v" in flags)) or c == "B" and inside:
                return -1, 0
        if c in "dDsSwW":
            return i + 2, None
        return i + 2, {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "b": 8}.get(c) or (None if c.isdigit() or c == "c" else ord(c))

    while i < n:
        c = body[i]
        if c == "\\":
            edge = body[i + 1 : i + 2] in ("b", "B")
            i, _ = escape(i, False)
            if i < 0:
                return False
            atom = not edge
        elif c == "[":
            m = re.compile(r"\[(?:[^\]\\]|\\[\s\S])*\]").match(body, i)
            if not m:
                return False
            if "v" in flags:  # classes in classes
                depth = 0
                while i < n:
                    if body[i] == "\\":
                        i += 1
                    depth += (body[i : i + 1] == "[") - (body[i : i + 1] == "]") if body[i - 1 : i] != "\\" else 0
                    i += 1
                    if not depth:
                        break
                if depth:
                    return False
            else:
                items, k, end = [], i + 1 + body.startswith("^", i + 1), m.end() - 1
                while k < end:
                    if body[k] == "\\":
                        k, x = escape(k, True)
                        if k < 0:
                            return False
                        items.append((False, x))
                    else:
                        items.append((body[k] == "-", ord(body[k])))
                        k += 1
                k = 0
                while k < len(items):
                    if k + 2 < len(items) and items[k + 1][0]:
                        a, b = items[k][1], items[k + 2][1]
                        if a is None or b is None:
                            if uni:
                                return False
                        elif a > b:
                            return False
                        k += 3
                    else:
                        k += 1
                i = m.end()
            atom = True
        elif c == "(":
            m = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<([^>]*)>))?").match(body, i)
            if body.startswith("(?", i) and m.end() == i + 1 or m.group(1) is not None and not re.fullmatch(r"(?:[^\W\d]|\$|\\u[0-9a-fA-F{}]+)(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F{}]+)*", m.group(1)):
                return False
            stack.append(m.group(0))
            i, atom = m.end(), False
        elif c == ")":
            if not stack:
                return False
            head = stack.pop()
            i, atom = i + 1, not (head in ("(?<=", "(?<!") or uni and head in ("(?=", "(?!"))
        elif c in "*+?" or c == "{":
            m = re.compile(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}").match(body, i)
            if not m:
                if uni:
                    return False
                i, atom = i + 1, True
                continue
            if not atom or m.group(3) and int(m.group(3)) < int(m.group(1)):
                return False
            i, atom = m.end() + body.startswith("?", m.end()), False
        elif c in "]}" and uni:
            return False
        else:
            i, atom = i + 1, c not in "|^$"
    return not stack and len(set(names)) == len(names)


def lex(text: str) -> list[str]:
    """Token classes with newline marks; ``ERR`` where no token fits (the rest is left out)."""
    out: list[str] = []
    at, n, nl = 0, len(text), False
    parens: list[bool] = []  # whether the bracket follows if, while, for or with
    braces: list[str] = []
    tags: list[bool] = []  # whether the open template has a tag, after which any escape may stand
    closed = ""  # what the last closing bracket ended: "head", "block", "value"
    if text.startswith("#!"):
        at = next((k for k in range(n) if text[k] in "\n\r"), n)

    def add(cls: str) -> None:
        nonlocal nl
        out.append(NL + cls if nl else cls)
        nl = False

    while at < n:
        c = text[at]
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1].lstrip(NL) if out else ""
            value = last in _VALUE_END or (last == ")" and closed != "head") or (last == "}" and closed == "value")
            if not value:
                m = _REGEX.match(text, at)
                if not m or not set(m.group(1)) <= set("dgimsuyv") or len(set(m.group(1))) < len(m.group(1)) or not _pattern(m.group(0)[1 : -1 - len(m.group(1))], m.group(1)):
                    add("ERR")
                    break
                add("REGEX")
                at = m.end()
                continue
        if c == "`" or (c == "}" and braces and braces[-1] == "tpl"):
            head = c == "`"
            m = _TEMPLATE.match(text, at + 1)
            if head:
                last = out[-1].lstrip(NL) if out else ""
                tags.append(last in _VALUE_END or (last == ")" and closed != "head") or (last == "}" and closed == "value"))
            if not m.group(1) or not tags[-1] and not _escaped(m.group(0), _TEMPLATE_ESCAPE):
                add("ERR")
                break
            at = m.end()
            if m.group(1) == "`":
                tags.pop()
            if not head:
                braces.pop()
            if m.group(1) == "`":
                add("TPL" if head else "TPLT")
            else:
                add("TPLH" if head else "TPLM")
                braces.append("tpl")
            continue
        m = _TOKEN.match(text, at)
        if not m:
            add("ERR")
            break
        kind, s = m.lastgroup, m.group(0)
        at = m.end()
        if kind == "str" and not _escaped(s) or kind == "num" and not _number(s, text[at : at + 1]) or kind == "name" and not _name(s):
            add("ERR")
            break
        if kind == "ws" or kind == "lc":
            continue
        if kind == "nl":
            nl = True
            continue
        if kind == "bc":
            nl = nl or bool(re.search(r"[\n\r  ]", s))
            continue
        if kind == "num":
            add("NUM")
        elif kind == "str":
            add("STR")
        elif kind == "name":
            add("PRIV" if s[0] == "#" else s if s in RESERVED or s in CONTEXTUAL else "NAME")
        else:
            last = out[-1].lstrip(NL) if out else ""
            if s == "(":
                parens.append(last in ("if", "while", "for", "with") or (last == "await" and len(out) > 1 and out[-2].lstrip(NL) == "for"))
            elif s == ")":
                closed = "head" if parens and parens.pop() else "value"
            elif s == "{":
                braces.append("value" if last in ("(", "[", ",", "=", ":", "?", "return", "=>" if False else "&&", "||", "??", "...", "typeof", "in", "of", "new", "TPLH", "TPLM") or last in ASSIGN else "block")
            elif s == "}":
                closed = braces.pop() if braces else "block"
            add(s)
    return out


class Bad(Exception):
    pass


class Parser:
    """Recursive descent; ``module`` and ``script`` goals are both accepted."""

    def __init__(self, tokens: list[str]):
        self.t = [x[1:] if x[0] == NL else x for x in tokens] + ["EOF"]
        self.n = [x[0] == NL for x in tokens] + [True]
        self.i = 0
        self.fn: list[tuple[bool, bool]] = []  # (async, generator) of the functions around
        self.loops, self.switches, self.labels = 0, 0, 0
        self.cover = 0
        match, stack = {}, []
        for k, x in enumerate(self.t):
            if x in ("(", "[", "{", "TPLH"):
                stack.append(k)
            elif x in (")", "]", "}") and stack:
                match[stack.pop()] = k
        self.match = match

    # helpers
    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j] if j < len(self.t) else "EOF"

    def take(self, *cls: str) -> str:
        x = self.t[self.i]
        if x not in cls:
            raise Bad(f"{x} at {self.i}, not {cls}")
        self.i += 1
        return x

    def accept(self, *cls: str) -> bool:
        if self.t[self.i] in cls:
            self.i += 1
            return True
        return False

    def semicolon(self) -> None:
        if self.accept(";"):
            return
        if self.peek() in ("}", "EOF") or self.n[self.i]:
            return
        raise Bad("no end of statement")

    def is_name(self, k: int = 0) -> bool:
        x = self.peek(k)
        if x == "NAME":
            return True
        if x == "await":
            return not (self.fn and self.fn[-1][0])
        if x == "yield":
            return not (self.fn and self.fn[-1][1])
        return x in CONTEXTUAL

    def binding_name(self) -> None:
        if not self.is_name():
            raise Bad("binding name")
        self.i += 1

    def program(self) -> None:
        while self.peek() != "EOF":
            self.item()
        if self.cover:
            raise Bad("initialiser in an object literal")

    # statements
    def item(self) -> None:
        x = self.peek()
        if x == "import" and self.peek(1) not in ("(", "."):
            return self.import_()
        if x == "export":
            return self.export()
        self.statement(True)

    def let_declaration(self) -> bool:
        return self.peek() == "let" and (self.peek(1) in ("[", "{") or self.is_name(1) and not (self.peek(1) in ("of",) and self.peek(2) != "of" and self.peek(2) != "="))

    def statement(self, declaration: bool = False) -> None:
        x = self.peek()
        cover = self.cover
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x == "var" or x == "const" or self.let_declaration():
            if x != "var" and not declaration:
                raise Bad("declaration here")
            self.i += 1
            self.declarators(x == "const")
            self.semicolon()
        elif x == "function" or (x == "async" and self.peek(1) == "function" and not self.n[self.i + 1]):
            self.function(True)
        elif x == "class":
            if not declaration:
                raise Bad("class here")
            self.class_(True)
        elif x == "if":
            self.i += 1
            self.parens()
            self.statement()
            if self.accept("else"):
                self.statement()
        elif x == "for":
            self.for_()
        elif x == "while":
            self.i += 1
            self.parens()
            self.body()
        elif x == "do":
            self.i += 1
            self.body()
            self.take("while")
            self.parens()
            self.accept(";")
        elif x in ("continue", "break"):
            self.i += 1
            if self.is_name() and not self.n[self.i]:
                if not self.labels:
                    raise Bad("label")
                self.i += 1
            elif not (self.loops or (x == "break" and self.switches)):
                raise Bad(x)
            self.semicolon()
        elif x == "return":
            if not self.fn:
                raise Bad("return")
            self.i += 1
            if self.peek() not in (";", "}", "EOF") and not self.n[self.i]:
                self.expression()
            self.semicolon()
        elif x == "throw":
            self.i += 1
            if self.n[self.i]:
                raise Bad("throw")
            self.expression()
            self.semicolon()
        elif x == "with":
            self.i += 1
            self.parens()
            self.statement()
        elif x == "switch":
            self.switch()
        elif x == "try":
            self.try_()
        elif x == "debugger":
            self.i += 1
            self.semicolon()
        elif x in ("import", "export") and self.peek(1) not in ("(", "."):
            raise Bad("import or export inside")
        elif self.is_name() and self.peek(1) == ":":
            self.i += 2
            self.labels += 1
            self.statement()
            self.labels -= 1
        else:
            self.expression()
            self.semicolon()
        if self.cover > cover:
            raise Bad("initialiser in an object literal")

    def body(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def block(self) -> None:
        self.take("{")
        while not self.accept("}"):
            self.statement(True)

    def parens(self) -> None:
        self.take("(")
        self.expression()
        self.take(")")

    def declarators(self, const: bool, in_: bool = True, head: bool = False) -> int:
        count = 0
        while True:
            pattern = self.peek() in ("[", "{")
            self.binding()
            count += 1
            if self.accept("="):
                self.assignment(in_)
            elif (const or pattern) and not (head and count == 1 and self.peek() in ("of", "in")):
                raise Bad("no initialiser")
            if not self.accept(","):
                return count

    def binding(self) -> None:
        x = self.peek()
        if x == "[":
            self.i += 1
            while not self.accept("]"):
                if self.accept(","):
                    continue
                if self.accept("..."):
                    self.binding()
                    self.take("]")
                    return
                self.binding()
                if self.accept("="):
                    self.assignment()
                if self.peek() != "]":
                    self.take(",")
        elif x == "{":
            self.i += 1
            while not self.accept("}"):
                if self.accept("..."):
                    self.binding_name()
                    self.take("}")
                    return
                named = self.is_name()
                self.property_name()
                if self.accept(":"):
                    self.binding()
                elif not named:
                    raise Bad("pattern")
                if self.accept("="):
                    self.assignment()
                if self.peek() != "}":
                    self.take(",")
        else:
            self.binding_name()

    def for_(self) -> None:
        self.take("for")
        self.accept("await")
        self.take("(")
        x = self.peek()
        if x == ";":
            pass
        elif x in ("var", "const") or self.let_declaration():
            self.i += 1
            many = self.declarators(x == "const", False, True)
            if many == 1 and self.peek() in ("of", "in"):
                return self.for_rest()
        else:
            cover = self.cover
            kind = self.expression(False)
            if self.peek() in ("of", "in"):
                if kind not in ("name", "member", "obj", "arr"):
                    raise Bad("for target")
                self.cover = cover
                return self.for_rest()
        self.take(";")
        if self.peek() != ";":
            self.expression()
        self.take(";")
        if self.peek() != ")":
            self.expression()
        self.take(")")
        self.body()

    def for_rest(self) -> None:
        if self.take("of", "in") == "of":
            self.assignment()
        else:
            self.expression()
        self.take(")")
        self.body()

    def switch(self) -> None:
        self.take("switch")
        self.parens()
        self.take("{")
        self.switches += 1
        defaults = 0
        while not self.accept("}"):
            if self.take("case", "default") == "case":
                self.expression()
            else:
                defaults += 1
            self.take(":")
            while self.peek() not in ("case", "default", "}"):
                self.statement(True)
        self.switches -= 1
        if defaults > 1:
            raise Bad("two defaults")

    def try_(self) -> None:
        self.take("try")
        self.block()
        done = False
        if self.accept("catch"):
            done = True
            if self.accept("("):
                self.binding()
                self.take(")")
            self.block()
        if self.accept("finally"):
            done = True
            self.block()
        if not done:
            raise Bad("try alone")

    def module_name(self) -> None:
        if self.peek() == "STR" or self.peek() in RESERVED or self.peek() in CONTEXTUAL or self.peek() == "NAME":
            self.i += 1
        else:
            raise Bad("name")

    def import_(self) -> None:
        self.take("import")
        if self.accept("STR"):
            return self.semicolon()
        more = True
        if self.is_name():
            self.i += 1
            more = self.accept(",")
        if more:
            if self.accept("*"):
                self.take("as")
                self.binding_name()
            else:
                self.take("{")
                while not self.accept("}"):
                    plain = self.is_name()
                    self.module_name()
                    if self.accept("as"):
                        self.binding_name()
                    elif not plain:
                        raise Bad("import name")
                    if self.peek() != "}":
                        self.take(",")
        self.take("from")
        self.take("STR")
        self.semicolon()

    def export(self) -> None:
        self.take("export")
        if self.accept("*"):
            if self.accept("as"):
                self.module_name()
            self.take("from")
            self.take("STR")
            self.semicolon()
        elif self.accept("{"):
            names = True
            while not self.accept("}"):
                names = names and self.is_name()
                self.module_name()
                if self.accept("as"):
                    self.module_name()
                if self.peek() != "}":
                    self.take(",")
            if self.accept("from"):
                self.take("STR")
            elif not names:
                raise Bad("export name")
            self.semicolon()
        elif self.accept("default"):
            x = self.peek()
            if x == "function" or (x == "async" and self.peek(1) == "function" and not self.n[self.i + 1]):
                self.function(False)
            elif x == "class":
                self.class_(False)
            else:
                self.assignment()
                self.semicolon()
        elif self.peek() in ("var", "const", "function", "class", "async") or self.let_declaration():
            self.statement(True)
        else:
            raise Bad("export")

    # functions and classes
    def function(self, named: bool) -> None:
        is_async = self.accept("async")
        self.take("function")
        star = self.accept("*")
        if self.is_name() or self.peek() in ("await", "yield"):
            self.i += 1
        elif named:
            raise Bad("function name")
        self.rest_of_function(is_async, star)

    def rest_of_function(self, is_async: bool, star: bool) -> None:
        self.fn.append((is_async, star))
        self.parameters()
        self.function_body()
        self.fn.pop()

    def parameters(self) -> None:
        self.take("(")
        while not self.accept(")"):
            if self.accept("..."):
                self.binding()
                self.take(")")
                return
            self.binding()
            if self.accept("="):
                self.assignment()
            if self.peek() != ")":
                self.take(",")

    def function_body(self) -> None:
        kept = self.loops, self.switches, self.labels
        self.loops = self.switches = self.labels = 0
        self.block()
        self.loops, self.switches, self.labels = kept

    def class_(self, named: bool) -> None:
        self.take("class")
        if self.is_name():
            self.i += 1
        elif named:
            raise Bad("class name")
        if self.accept("extends"):
            self.left()
        self.take("{")
        while not self.accept("}"):
            if self.accept(";"):
                continue
            ends = ("(", "=", ";", "}")
            if self.peek() == "static" and self.peek(1) not in ends:
                self.i += 1
                if self.peek() == "{":
                    kept = self.fn
                    self.fn = []
                    self.function_body()
                    self.fn = kept
                    continue
            is_async = star = False
            if self.peek() == "async" and self.peek(1) not in ends and not self.n[self.i + 1]:
                self.i += 1
                is_async = True
            if self.accept("*"):
                star = True
            elif not is_async and self.peek() in ("get", "set") and self.peek(1) not in ends and not (self.n[self.i + 1] and self.peek(1) == "*"):
                self.i += 1
            if not self.accept("PRIV"):
                self.property_name()
            if self.peek() == "(":
                self.rest_of_function(is_async, star)
            else:
                if is_async or star:
                    raise Bad("class member")
                if self.accept("="):
                    self.fn.append((False, False))
                    self.assignment()
                    self.fn.pop()
                self.semicolon()

    def property_name(self) -> None:
        x = self.peek()
        if x in ("NAME", "STR", "NUM") or x in RESERVED or x in CONTEXTUAL:
            self.i += 1
        elif x == "[":
            self.i += 1
            self.assignment()
            self.take("]")
        else:
            raise Bad("property name")

    # expressions; each returns what kind of target it could be
    def expression(self, in_: bool = True) -> str:
        kind = self.assignment(in_)
        while self.accept(","):
            self.assignment(in_)
            kind = "other"
        return kind

    def arrow_ahead(self) -> int:
        """Tokens before the ``=>`` of an arrow function that begins here, or 0."""
        k = self.i
        if self.t[k] == "async" and not self.n[k + 1] and (self.t[k + 1] == "(" or (self.is_name(1) and self.t[k + 2] == "=>" )):
            k += 1
        if self.t[k] == "(":
            e = self.match.get(k)
            if e is not None and self.t[e + 1] == "=>" and not self.n[e + 1]:
                return e + 1
            return 0
        if (self.t[k] == "NAME" or self.t[k] in CONTEXTUAL) and self.t[k + 1] == "=>" and not self.n[k + 1]:
            return k + 1
        return 0

    def assignment(self, in_: bool = True) -> str:
        x = self.peek()
        if x == "yield" and self.fn and self.fn[-1][1]:
            self.i += 1
            if not self.n[self.i] and self.peek() not in (")", "]", "}", ",", ";", ":", "EOF", "in", "of", "TPLM", "TPLT"):
                self.accept("*")
                self.assignment(in_)
            return "other"
        if x in ("(", "NAME") or x in CONTEXTUAL:
            arrow = self.arrow_ahead()
            if arrow:
                is_async = x == "async" and self.i + 1 < arrow
                if is_async:
                    self.i += 1
                self.fn.append((is_async, False))
                if self.peek() == "(":
                    self.parameters()
                else:
                    self.binding_name()
                self.take("=>")
                if self.peek() == "{":
                    self.function_body()
                else:
                    self.assignment(in_)
                self.fn.pop()
                return "other"
        cover = self.cover
        kind = self.conditional(in_)
        op = self.peek()
        if op in ASSIGN:
            if op == "=":
                if kind not in ("name", "member", "obj", "arr"):
                    raise Bad("assignment target")
                if kind in ("obj", "arr"):
                    self.cover = cover
            elif kind not in ("name", "member"):
                raise Bad("assignment target")
            self.i += 1
            self.assignment(in_)
            return "other"
        return kind

    def conditional(self, in_: bool) -> str:
        kind = self.binary(0, in_)
        if self.accept("?"):
            self.assignment()
            self.take(":")
            self.assignment(in_)
            return "other"
        return kind

    def binary(self, least: int, in_: bool) -> str:
        if self.peek() == "PRIV" and self.peek(1) == "in":
            self.i += 1
            kind = "other"
        else:
            kind = self.unary()
        mixed = ""
        while True:
            op = self.peek()
            p = BINARY.get(op)
            if p is None or p <= least or (op == "in" and not in_):
                return kind
            if op in ("??", "||", "&&"):
                if mixed and (mixed == "??") != (op == "??"):
                    raise Bad("mixed ?? and ||")
                mixed = op
            if op == "**" and kind == "unary":
                raise Bad("unary before **")
            self.i += 1
            self.binary(p - 1 if op == "**" else p, in_)
            kind = "other"

    def unary(self) -> str:
        x = self.peek()
        if x in UNARY:
            self.i += 1
            self.unary()
            return "unary"
        if x in ("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "member"):
                raise Bad("++ target")
            return "other"
        if x == "await" and (not self.fn or self.fn[-1][0]) and (self.fn or self.peek(1) not in (";", ")", ",", "=", "=>", ".", "EOF", "]", "}", ":", "?", "==", "===") and not self.n[self.i + 1]):
            self.i += 1
            self.unary()
            return "unary"
        kind = self.left()
        if self.peek() in ("++", "--") and not self.n[self.i]:
            if kind not in ("name", "member"):
                raise Bad("++ target")
            self.i += 1
            return "other"
        return kind

    def arguments(self) -> None:
        self.take("(")
        while not self.accept(")"):
            self.accept("...")
            self.assignment()
            if self.peek() != ")":
                self.take(",")

    def template(self) -> None:
        if self.accept("TPL"):
            return
        self.take("TPLH")
        self.expression()
        while self.accept("TPLM"):
            self.expression()
        self.take("TPLT")

    def left(self) -> str:
        x = self.peek()
        if x == "new":
            self.i += 1
            if self.accept("."):
                self.take("target")
                kind = "other"
            else:
                self.left_without_calls()
                if self.peek() == "(":
                    self.arguments()
                kind = "other"
        elif x == "super":
            self.i += 1
            if self.peek() not in ("(", ".", "["):
                raise Bad("super")
            kind = "other"
        elif x == "import":
            self.i += 1
            if self.accept("."):
                self.take("meta")
            else:
                self.take("(")
                self.assignment()
                self.take(")")
            kind = "other"
        else:
            kind = self.primary()
        return self.tails(kind, True)

    def left_without_calls(self) -> None:
        if self.accept("new"):
            if self.accept("."):
                self.take("target")
            else:
                self.left_without_calls()
                if self.peek() == "(":
                    self.arguments()
        else:
            self.primary()
        self.tails("other", False)

    def tails(self, kind: str, calls: bool) -> str:
        optional = False
        while True:
            x = self.peek()
            if x == ".":
                self.i += 1
                if not self.accept("PRIV"):
                    y = self.peek()
                    if y not in RESERVED and y not in CONTEXTUAL and y != "NAME":
                        raise Bad("member")
                    self.i += 1
                kind = "other" if optional else "member"
            elif x == "?." and calls:
                self.i += 1
                optional = True
                y = self.peek()
                if y == "(":
                    self.arguments()
                elif y == "[":
                    self.i += 1
                    self.expression()
                    self.take("]")
                elif y == "PRIV" or y == "NAME" or y in RESERVED or y in CONTEXTUAL:
                    self.i += 1
                else:
                    raise Bad("?.")
                kind = "other"
            elif x == "[":
                self.i += 1
                self.expression()
                self.take("]")
                kind = "other" if optional else "member"
            elif x == "(" and calls:
                self.arguments()
                kind = "call"
            elif x in ("TPL", "TPLH"):
                self.template()
                kind = "other"
            else:
                return kind

    def primary(self) -> str:
        x = self.peek()
        if x == "function" or (x == "async" and self.peek(1) == "function" and not self.n[self.i + 1]):
            self.function(False)
            return "other"
        if self.is_name():
            self.i += 1
            return "name"
        if x in ("NUM", "STR", "REGEX", "this", "null", "true", "false"):
            self.i += 1
            return "other"
        if x in ("TPL", "TPLH"):
            self.template()
            return "other"
        if x == "(":
            self.i += 1
            kind = self.expression()
            self.take(")")
            return kind if kind in ("name", "member") else "other"
        if x == "[":
            self.i += 1
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.assignment()
                if self.peek() != "]":
                    self.take(",")
            return "arr"
        if x == "{":
            self.object()
            return "obj"
        if x == "class":
            self.class_(False)
            return "other"
        raise Bad(f"{x} begins no expression")

    def object(self) -> None:
        self.take("{")
        ends = ("(", ",", ":", "}", "=")
        while not self.accept("}"):
            if self.accept("..."):
                self.assignment()
            else:
                is_async = star = accessor = False
                if self.peek() == "async" and self.peek(1) not in ends and not self.n[self.i + 1]:
                    self.i += 1
                    is_async = True
                if self.accept("*"):
                    star = True
                elif not is_async and self.peek() in ("get", "set") and self.peek(1) not in ends:
                    self.i += 1
                    accessor = True
                plain = self.is_name()
                self.property_name()
                if self.peek() == "(":
                    self.rest_of_function(is_async, star)
                elif is_async or star or accessor:
                    raise Bad("method")
                elif self.accept(":"):
                    self.assignment()
                elif not plain:
                    raise Bad("property")
                elif self.accept("="):
                    self.cover += 1
                    self.assignment()
            if self.peek() != "}":
                self.take(",")


def valid(tokens: list[str]) -> bool:
    """Whether the token classes form a script or module; RecursionError if they are nested too deep to tell."""
    try:
        Parser(tokens).program()
        return True
    except (Bad, IndexError):
        return False
