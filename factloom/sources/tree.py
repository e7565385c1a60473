"""Syntax trees of Kotlin, Java and build scripts as rows.

A tokenizer that knows comments, nested strings and brackets feeds a tolerant
statement parser; whatever it doesn't know is an expression, so every text
gives a tree. Texts are parsed one by one over Arrow batches, without a
shuffle. Ids count in document order, so the nodes below a node are those with
ids up to its ``subtree_end``.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Node types that metrics and rules ask for.
DECISIONS = {"if_expression", "for_statement", "while_statement", "do_while_statement", "when_entry", "catch_block", "conjunction_expression", "disjunction_expression"}
COGNITIVE = {"if_expression", "for_statement", "while_statement", "do_while_statement", "when_expression", "catch_block"}
NESTING = {"if_expression", "for_statement", "while_statement", "do_while_statement", "when_expression"}
DECLARATIONS = {"class_declaration", "interface_declaration", "object_declaration", "function_declaration", "property_declaration"}
OPERATORS = {"&&": "conjunction_expression", "||": "disjunction_expression", "?:": "elvis_expression"}
# Words before a declaration.
MODIFIERS = set("public private internal protected open abstract sealed data override suspend inline static final enum annotation inner value companion lateinit const operator infix tailrec external expect actual crossinline noinline vararg synchronized transient volatile default native strictfp record".split())

#: Brackets nested deeper than this are read as one token of their parent.
DEEPEST = 120
#: Rows of one batch of the result.
ROWS = 50_000

_TOKEN = re.compile(r"//[^\n\r]*|/\*|\"\"\"|[\"']|\d[\w.]*|`[^`\n]*`|[^\W\d]\w*|@[\w:.]+|&&|\|\||\?:|\?\.|->|::|==|!=|<=|>=|\r\n|[\n\r]|[^\S\n\r]+|.", re.S)
_CONTINUES = {".", "?.", "::", "&&", "||", "?:", "+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", ",", ":", "->", "(", "[", "{"}
_LEADS = {".", "?.", "::", "&&", "||", "?:", ":", "{", ")", "]", "else", "where", "catch", "finally", "throws", "extends", "implements"}
_LOOPS = {"for": "for_statement", "while": "while_statement"}

_ARROW = [("id", pa.int32()), ("parent", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("row", pa.int32()), ("subtree_end", pa.int32()), ("depth", pa.int32()), ("owner", pa.int32()), ("nesting", pa.int32()), ("cognitive", pa.int32()), ("modifiers", pa.string()), ("scope", pa.string()), ("arity", pa.int32())]
COLUMNS = "id int, parent int, type string, name string, start bigint, stop bigint, row int, subtree_end int, depth int, owner int, nesting int, cognitive int, modifiers string, scope string, arity int"


def _closed(text: str, at: int, opening: str, level: int = 0) -> int:
    """Where a string or block comment that starts at ``at`` ends; the end of the line or text if it isn't closed."""
    n = len(text)
    if opening == "/*":
        depth, i = 1, at + 2
        for m in re.compile(r"/\*|\*/").finditer(text, i):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return n
    if opening == '"""':
        end = text.find('"""', at + 3)
        return n if end < 0 else end + 3
    i = at + 1
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == opening:
            return i + 1
        elif c in "\n\r":
            return i
        elif c == "$" and opening == '"' and text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth and text[i] not in "\n\r":
                if text[i] == '"' and level < 8:
                    i = _closed(text, i, '"', level + 1)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return n


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, stop): word, string, comment, number, mark, annotation or line."""
    at, n = 0, len(text)
    match = _TOKEN.match
    while at < n:
        m = match(text, at)
        tok, end = m.group(), m.end()
        if tok in ("/*", '"""', '"', "'"):
            end = _closed(text, at, tok)
            yield ("comment" if tok == "/*" else "string"), text[at:end], at, end
        elif tok.startswith("//"):
            yield "comment", tok, at, end
        elif tok in ("\n", "\r", "\r\n"):
            yield "line", tok, at, end
        elif tok.isspace():
            pass
        elif tok[0] == "@" and len(tok) > 1:
            yield "annotation", tok, at, end
        elif tok[0].isdigit():
            yield "number", tok, at, end
        elif tok[0].isalpha() or tok[0] in "_`":
            yield "word", tok, at, end
        else:
            yield "mark", tok, at, end
        at = end


class _Parser:
    """One text to rows; a node is a list in the order of COLUMNS."""

    def __init__(self, text: str, language: str):
        self.text, self.java = text, language == "java"
        self.toks = list(tokens(text))
        self.toks.append(("end", "", len(text), len(text)))
        self.i, self.rows, self.line, self.seen = 0, [], 0, 0
        # Open nodes, and for each how often metrics are nested there.
        self.path: list[tuple[int, int | None, int, int, str]] = []

    # -- nodes

    def open(self, type_: str, start: int, name: str = "", chained: bool = False, modifiers: str = "") -> int:
        id_ = len(self.rows)
        parent, owner, nesting, cognitive, scope = self.path[-1] if self.path else (None, None, 0, 0, "")
        self.line += self.text.count("\n", self.seen, start)
        self.seen = max(self.seen, start)
        inner = nesting + (type_ in NESTING and not chained)
        self.rows.append([id_, parent, type_, name, start, start, self.line, id_, len(self.path), owner, inner, cognitive, modifiers, scope, None])
        if type_ in DECLARATIONS and name:
            scope = f"{scope}.{name}" if scope else name
        if type_ in ("function_declaration", "lambda_literal"):
            self.path.append((id_, id_, 0, 0, scope))
        else:
            self.path.append((id_, owner, inner, cognitive + (type_ in COGNITIVE), scope))
        return id_

    def close(self, id_: int, stop: int | None = None) -> None:
        self.path.pop()
        self.rows[id_][5] = self.toks[self.i - 1][3] if stop is None else stop
        self.rows[id_][7] = len(self.rows) - 1

    def leaf(self, type_: str, tok: tuple, name: str = "") -> None:
        self.close(self.open(type_, tok[2], name), tok[3])

    # -- tokens

    def peek(self, skip_lines: bool = False) -> tuple[str, str, int, int]:
        while True:
            t = self.toks[self.i]
            if t[0] == "comment":
                self.leaf("comment", t)
            elif not (skip_lines and t[0] == "line"):
                return t
            self.i += 1

    def take(self) -> tuple[str, str, int, int]:
        t = self.toks[self.i]
        self.i += t[0] != "end"
        return t

    def ahead(self) -> str:
        """The next word or mark, beyond lines and comments, without taking anything."""
        j = self.i
        while self.toks[j][0] in ("line", "comment"):
            j += 1
        return self.toks[j][1]

    def accept(self, what: str, skip_lines: bool = True) -> bool:
        if skip_lines and self.ahead() != what:
            return False
        if self.peek(skip_lines)[1] != what:
            return False
        self.take()
        return True

    # -- grammar

    def file(self) -> list[list]:
        root = self.open("source_file", 0)
        while self.toks[self.i][0] != "end":
            self.statements("", in_class=self.java)
            if self.toks[self.i][0] != "end":
                self.take()
        self.close(root, len(self.text))
        return self.rows

    def statements(self, until: str, in_class: bool = False) -> None:
        while True:
            t = self.peek(skip_lines=True)
            if t[0] == "end" or t[1] in ("}", ")", "]"):
                return
            if t[1] in (";", ","):
                self.take()
                continue
            before = self.i
            self.statement(in_class)
            if self.i == before:
                self.take()

    def statement(self, in_class: bool) -> None:
        start, words = self.peek(skip_lines=True)[2], []
        first = self.i
        while True:
            t = self.peek(skip_lines=bool(words))
            if t[0] == "annotation":
                self.take()
                self.leaf("annotation", t, t[1][1:])
                if self.toks[self.i][1] == "(":
                    self.group("(", ")")
                words.append(t[1])
            elif t[0] == "word" and t[1] in MODIFIERS and self.toks[self.i + 1][1] not in (".", "(", "=", ":", "}", ")"):
                words.append(self.take()[1])
            else:
                break
        kind, said, at, _ = t
        modifiers = " ".join(w for w in words if w[0] != "@")
        if kind == "word" and said in ("package", "import") and not words:
            self.rest_of_line("package_header" if said == "package" else "import_header", at)
        elif kind == "word" and said in ("class", "interface", "object") and self.named():
            self.type_declaration(start, said, modifiers)
        elif kind == "word" and said == "fun" and self.named():
            self.function(start, modifiers)
        elif kind == "word" and said in ("val", "var") and not (self.java and in_class and said == "val"):
            self.take()
            self.property(start, self.name(), modifiers)
        elif words and modifiers == "enum" and kind == "word":
            self.type_declaration(start, "enum", modifiers)
        elif in_class and kind == "mark" and said == "{" and words:
            self.block("block")
        elif in_class and self.java and kind == "word" and self.member(start, modifiers):
            pass
        elif self.i > first and kind in ("line", "end"):
            return
        else:
            self.expression(statement=True)

    def named(self) -> bool:
        if len(self.path) > DEEPEST:
            return False
        return self.toks[self.i + 1][0] in ("word", "mark", "line") and self.toks[self.i + 1][1] not in ("=", ".", ")", ",", ";", "")

    def name(self) -> str:
        """The last part of a dotted name, with type parameters or a receiver before it."""
        found = ""
        while True:
            t = self.peek()
            if t[0] == "word" and t[1] not in ("by", "where"):
                found = self.take()[1].strip("`")
            elif t[1] == "<":
                self.angles()
            elif t[1] in (".", "?.", "?"):
                self.take()
            else:
                return found
            if t[0] == "word" and self.toks[self.i][1] not in (".", "?.", "<", "?"):
                return found

    def angles(self) -> None:
        depth = 0
        while (t := self.toks[self.i])[0] != "end":
            depth += (t[1] == "<") - (t[1] == ">")
            if t[1] in ("{", "}", ";", "(", ")"):
                return
            self.take()
            if depth <= 0:
                return

    def rest_of_line(self, type_: str, start: int) -> None:
        self.take()
        parts = []
        while (t := self.toks[self.i])[0] not in ("line", "end", "comment") and t[1] != ";":
            parts.append(self.take()[1])
        said = "".join(p if p not in ("static", "as") else f"{p} " for p in parts).removeprefix("static ").split("as ")[0]
        self.close(self.open(type_, start, said))

    def type_declaration(self, start: int, word: str, modifiers: str) -> None:
        self.take()
        if word == "class" and self.ahead() == "class":
            self.take()
        name = self.name() if self.peek()[0] == "word" else ""
        type_ = {"object": "object_declaration", "interface": "interface_declaration"}.get(word, "class_declaration")
        id_ = self.open(type_, start, name, modifiers=modifiers)
        self.header()
        if self.ahead() == "{":
            self.peek(skip_lines=True)
            self.block("class_body", in_class=True)
        self.close(id_)

    def header(self) -> None:
        """What stands between a name and a body: parameters, supertypes, bounds."""
        while True:
            t = self.peek()
            if t[0] == "line":
                if self.ahead() not in _LEADS or self.ahead() == "{":
                    return
                self.peek(skip_lines=True)
            elif t[1] == "(":
                holder = self.rows[self.path[-1][0]]
                if holder[14] is None:
                    holder[14] = self.count_parts(self.i)
                self.group("(", ")", "parameters")
            elif t[1] == "<":
                self.angles()
            elif t[0] == "end" or t[1] in ("{", "}", "=", ";", ")"):
                return
            else:
                if t[0] == "word" and t[1][0].isupper():
                    self.leaf("type_identifier", t, t[1])
                elif t[0] == "annotation":
                    self.leaf("annotation", t, t[1][1:])
                self.take()

    def function(self, start: int, modifiers: str) -> None:
        self.take()
        id_ = self.open("function_declaration", start, self.name(), modifiers=modifiers)
        self.body()
        self.close(id_)

    def body(self) -> None:
        self.header()
        if self.ahead() == "{":
            self.peek(skip_lines=True)
            self.block("function_body")
        elif self.accept("=", skip_lines=False):
            self.expression()

    def property(self, start: int, name: str, modifiers: str, inside: bool = False) -> None:
        id_ = self.open("property_declaration", start, name, modifiers=modifiers)
        self.expression(inside=inside)
        if inside:
            return self.close(id_)
        while self.ahead() in ("get", "set") and not self.java:
            # An accessor belongs to the property if parentheses and a body follow.
            j = self.i
            while self.toks[j][0] in ("line", "comment"):
                j += 1
            if self.toks[j + 1][1] != "(":
                break
            self.peek(skip_lines=True)
            t = self.take()
            inner = self.open("getter" if t[1] == "get" else "setter", t[2])
            self.body()
            self.close(inner)
        self.close(id_)

    def member(self, start: int, modifiers: str) -> bool:
        """A Java method, constructor or field: a type and a name, then ``(``, ``=`` or ``;``."""
        j, names, depth = self.i, [], 0
        while True:
            kind, said, _, _ = self.toks[j]
            if said == "<":
                depth += 1
            elif said == ">":
                depth -= 1
            elif depth == 0 and kind == "word":
                names.append(said)
            elif depth == 0 and said not in (".", "[", "]", "?"):
                break
            elif kind == "end" or said in ("{", "}", ";", "("):
                break
            j += 1
        if not names or (set(names) & {"return", "throw", "new", "if", "for", "while", "do", "switch", "try", "else", "case", "assert"}):
            return False
        if said == "(":
            close = self.matching(j)
            if self.toks[close][1] not in ("{", "throws", ";", "line") or (len(names) == 1 and self.toks[close][1] == ";"):
                return False
            self.i = j
            id_ = self.open("function_declaration", start, names[-1], modifiers=modifiers)
            self.body()
            self.close(id_)
            return True
        if said in ("=", ";", ",") and len(names) > 1:
            self.i = j
            self.property(start, names[-1], modifiers)
            return True
        return False

    def matching(self, j: int) -> int:
        """The token after the bracket that closes the one at ``j``, beyond lines and comments."""
        depth = 0
        while self.toks[j][0] != "end":
            depth += (self.toks[j][1] in "([{" and self.toks[j][0] == "mark") - (self.toks[j][1] in ")]}" and self.toks[j][0] == "mark")
            j += 1
            if depth <= 0:
                break
        while self.toks[j][0] in ("line", "comment"):
            j += 1
        return j

    def count_parts(self, j: int) -> int:
        """How many parts the bracket at ``j`` holds between commas that no other bracket encloses."""
        depth, commas, last = 0, 0, ""
        while (t := self.toks[j])[0] != "end":
            if t[0] == "mark":
                depth += (t[1] in "([{<") - (t[1] in ")]}>")
                if depth == 0:
                    break
                commas += t[1] == "," and depth == 1
            last = t[1] if t[0] not in ("line", "comment") else last
            j += 1
        return 0 if last == "(" else commas + (last != ",")

    def flat(self, opening: str, closing: str) -> None:
        """Over a bracket without looking into it."""
        depth = 0
        while (t := self.toks[self.i])[0] != "end":
            depth += (t[1] == opening) - (t[1] == closing)
            self.take()
            if depth <= 0:
                return

    def group(self, opening: str, closing: str, type_: str = "value_arguments") -> None:
        if len(self.path) > DEEPEST:
            return self.flat(opening, closing)
        t = self.take()
        id_ = self.open(type_, t[2])
        while (t := self.peek(skip_lines=True))[0] != "end" and t[1] not in (")", "]", "}"):
            if t[1] in (",", ";"):
                self.take()
                continue
            before = self.i
            if type_ == "parameters" and t[1] in ("val", "var"):
                self.take()
                self.property(t[2], self.name(), "", inside=True)
            else:
                self.expression(inside=True)
            if self.i == before:
                self.take()
        if self.peek(skip_lines=True)[1] == closing:
            self.take()
        self.close(id_)

    def block(self, type_: str, in_class: bool = False) -> None:
        if len(self.path) > DEEPEST:
            return self.flat("{", "}")
        t = self.take()
        id_ = self.open(type_, t[2])
        self.statements("}", in_class)
        if self.toks[self.i][1] == "}":
            self.take()
        self.close(id_)

    def controlled(self) -> None:
        """The body of a control structure: a block or one statement."""
        if self.ahead() == "{":
            self.peek(skip_lines=True)
            self.block("control_structure_body")
        elif self.toks[self.i][1] != ";":
            self.peek(skip_lines=True)
            self.statement(False)

    def control(self, chained: bool = False) -> bool:
        """A control structure, if the next word starts one."""
        kind, said, at, _ = self.peek()
        if kind != "word" or len(self.path) > DEEPEST or self.toks[self.i - 1][1] in (".", "?.", "::"):
            return False
        if said == "if":
            self.take()
            id_ = self.open("if_expression", at, chained=chained)
            if self.accept_group():
                self.controlled()
                semi = self.toks[self.i][1] == ";" and self.toks[self.i + 1][1] == "else"
                self.i += semi
                if self.ahead() == "else" and self.next_after_else() != "->":
                    self.peek(skip_lines=True)
                    self.take()
                    if self.ahead() == "if":
                        self.peek(skip_lines=True)
                        self.control(chained=True)
                    else:
                        self.controlled()
            self.close(id_)
        elif said in _LOOPS:
            self.take()
            id_ = self.open(_LOOPS[said], at)
            if self.accept_group():
                self.controlled()
            self.close(id_)
        elif said == "do" and self.ahead_is("{"):
            self.take()
            id_ = self.open("do_while_statement", at)
            self.controlled()
            if self.accept("while"):
                self.accept_group()
            self.close(id_)
        elif said in ("when", "switch") and self.ahead_is("(", "{"):
            self.take()
            id_ = self.open("when_expression", at)
            self.accept_group()
            if self.ahead() == "{":
                self.peek(skip_lines=True)
                self.entries()
            self.close(id_)
        elif said == "try" and self.ahead_is("{", "("):
            self.take()
            id_ = self.open("try_expression", at)
            self.accept_group()
            if self.ahead() == "{":
                self.controlled()
            while self.ahead() in ("catch", "finally"):
                t = self.peek(skip_lines=True)
                self.take()
                part = self.open("catch_block" if t[1] == "catch" else "finally_block", t[2])
                self.accept_group()
                self.controlled()
                self.close(part)
            self.close(id_)
        else:
            return False
        return True

    def next_after_else(self) -> str:
        j = self.i
        while self.toks[j][0] in ("line", "comment"):
            j += 1
        return self.toks[j + 1][1]

    def ahead_is(self, *what: str) -> bool:
        j = self.i + 1
        while self.toks[j][0] in ("line", "comment"):
            j += 1
        return self.toks[j][1] in what

    def accept_group(self) -> bool:
        if self.ahead() != "(":
            return False
        self.peek(skip_lines=True)
        self.group("(", ")", "condition")
        return True

    def entries(self) -> None:
        """The branches of a ``when`` or ``switch``."""
        self.take()
        while (t := self.peek(skip_lines=True))[0] != "end" and t[1] != "}":
            before = self.i
            id_ = self.open("when_entry", t[2])
            while (t := self.peek(skip_lines=True))[0] != "end" and t[1] not in ("->", "}", ":"):
                if t[1] in ("(", "["):
                    self.group(t[1], ")" if t[1] == "(" else "]")
                elif t[1] == "{":
                    self.block("lambda_literal")
                else:
                    if t[1] in OPERATORS:
                        self.leaf(OPERATORS[t[1]], t)
                    self.take()
            if t[1] in ("->", ":"):
                self.take()
                if t[1] == "->":
                    self.controlled()
                else:
                    while (t := self.peek(skip_lines=True))[0] != "end" and t[1] not in ("case", "default", "}"):
                        step = self.i
                        self.statement(False)
                        if self.i == step or self.toks[self.i][1] == ";":
                            self.take()
            self.close(id_)
            if self.i == before:
                self.take()
        if self.toks[self.i][1] == "}":
            self.take()

    def expression(self, statement: bool = False, inside: bool = False) -> None:
        """Up to the end of the statement, or the next comma or closing bracket within brackets."""
        last = ""
        while True:
            t = self.peek(skip_lines=inside)
            kind, said, at, _ = t
            if kind == "end" or said in (")", "]", "}", ";", "else") or (said == "," and (inside or statement)):
                return
            if kind == "line":
                if last in _CONTINUES or self.ahead() in (".", "?.", "?:", "&&", "||"):
                    self.peek(skip_lines=True)
                    continue
                return
            if self.control():
                last = "}"
            elif kind == "word" and said in ("fun", "object") and self.toks[self.i + 1][1] in ("(", ":", "{"):
                self.take()
                id_ = self.open("lambda_literal" if said == "fun" else "object_literal", at)
                self.header()
                if self.ahead() == "{":
                    self.peek(skip_lines=True)
                    self.block("class_body" if said == "object" else "function_body", in_class=said == "object")
                self.close(id_)
                last = "}"
            elif said == "{":
                self.block("lambda_literal" if not self.java or last == "->" else "block")
                last = "}"
                if statement and self.java:
                    return
            elif said == "(":
                self.group("(", ")")
                last = ")"
            elif said == "[":
                self.group("[", "]", "indexing")
                last = "]"
            else:
                self.take()
                follows = self.toks[self.i][1]
                if kind == "string":
                    self.leaf("string_literal", t)
                elif said in OPERATORS:
                    self.leaf(OPERATORS[said], t)
                elif said in ("return", "throw", "break", "continue"):
                    self.leaf("jump_expression", t, said)
                elif kind == "word" and follows == "(" and len(self.path) <= DEEPEST:
                    id_ = self.open("call_expression", at, said.strip("`"))
                    self.group("(", ")")
                    if self.toks[self.i][1] == "{" and not self.java:
                        self.block("lambda_literal")
                    self.close(id_)
                    said = ")"
                elif kind == "word" and follows == "{" and not self.java and (last in (".", "?.") or statement) and said not in ("else", "do", "try"):
                    id_ = self.open("call_expression", at, said.strip("`"))
                    self.block("lambda_literal")
                    self.close(id_)
                    said = "}"
                elif kind == "word":
                    self.leaf("simple_identifier", t, said.strip("`"))
                last = said


def parse(text: str, language: str = "kotlin") -> list[list]:
    """The nodes of one text in document order; offsets are in characters."""
    return _Parser(text, language).file()


def syntax_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "language", types: Iterable[str] | None = None) -> DataFrame:
    """(key, id, parent, type, name, start, stop, row, subtree_end, depth, owner, nesting, cognitive, modifiers, scope, arity): the nodes of every text.

    ``start`` and ``stop`` are bytes of the UTF-8 text, ``row`` counts lines
    from 0. ``owner`` is the nearest function or lambda around the node,
    ``nesting`` how many control structures of it enclose the node, itself
    included and ``else if`` counted once, ``cognitive`` how many of those that
    make a function hard to read enclose it. ``scope`` is the dotted names of the declarations
    around the node, ``arity`` how many parameters a declaration takes, null
    without a list of them. An empty text gives its root, a null one nothing; a null language is read like Kotlin. Brackets more than
    DEEPEST levels deep are not looked into. With ``types``, only nodes of these
    leave Python; their ids stay those of the whole tree.
    """
    wanted = None if types is None else frozenset(types)
    kind = docs.schema[key].dataType.simpleString()
    names = [n for n, _ in _ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns = [], [[] for _ in _ARROW]

            def flush() -> pa.RecordBatch:
                arrays = [pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW))]
                return pa.RecordBatch.from_arrays(arrays, names=[key, *names])

            for k, source, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if source is None:
                    continue
                gc.disable()  # a tree has no cycles, and the collector would walk it again and again
                try:
                    rows = parse(source, lang or "kotlin")
                finally:
                    gc.enable()
                if wanted is not None:
                    rows = [r for r in rows if r[2] in wanted]
                if not source.isascii():
                    # Bytes before each character.
                    at = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in source)]
                    for r in rows:
                        r[4], r[5] = at[r[4]], at[r[5]]
                keys += [k] * len(rows)
                for column, values in zip(columns, zip(*rows)):
                    column += values
                if len(keys) > ROWS:
                    yield flush()
                    keys, columns = [], [[] for _ in _ARROW]
            yield flush()

    return docs.select(key, text, language).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")
