"""Facts of Dart sources: one pass of a scanner and outline parser a file.

``facts(source)`` is a plain function; ``extract`` maps it over files(path, source)
and gives one row a file with nested facts, and ``fact`` explodes one of them into
a table. The parser knows outlines and statements, not types; a construct it
doesn't know is stepped over, and the file is marked ``complete = false``.
Lines are 1-based, columns are 0-based UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMB = "array<struct<kind:string,names:array<string>>>"
SCHEMA = f"""path string, complete boolean, library string, part_of string, line_count bigint,
directives array<struct<kind:string,ordinal:bigint,uri:string,variable:string,expected:string,prefix:string,deferred:boolean,combinators:{_COMB},line:bigint,col:bigint>>,
declarations array<struct<kind:string,name:string,line:bigint,col:bigint,start_line:bigint,end_line:bigint>>,
members array<struct<owner:string,kind:string,name:string,has_body:boolean,line:bigint,col:bigint>>,
supertypes array<struct<owner:string,clause:string,name:string>>,
functions array<struct<symbol:string,kind:string,owner:string,line:bigint,col:bigint,end_line:bigint,cyclomatic:bigint,cognitive:bigint>>,
calls array<struct<callee:string,line:bigint,col:bigint>>,
refs array<struct<name:string,qualifier:string,line:bigint,col:bigint>>,
routes array<struct<route_class:string,route_path:string,name:string,line:bigint,col:bigint>>,
literals array<struct<value:string,line:bigint,col:bigint>>""".replace("\n", " ")

_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
|(?P<op>\?\?=|\?\?|\?\.\.|\?\.|&&|\|\||=>|==|!=|<=|>=|\.\.\.\?|\.\.\.|\.\.|\+\+|--|[-+*/%&|^~<>=!?:;,.(){}\[\]@\#])""", re.X)
_KEYWORDS = set("abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory false final finally for get hide if implements import in interface is late library mixin new null of on operator part required rethrow return sealed set show static super switch sync this throw true try typedef var void when while with yield augment".split())
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "assert", "super", "this", "await", "throw", "in", "is", "as", "when"}
_ROUTES = {"GoRoute", "TypedGoRoute", "AutoRoute", "StatefulShellRoute", "ShellRoute"}


class Token(NamedTuple):
    kind: str  # id, num, str, op
    text: str  # of a string: its value
    at: int
    end: int


def scan(source: str) -> tuple[list[Token], bool]:
    """Tokens without comments; strings give their value and the tokens of what they interpolate."""
    out: list[Token] = []
    i, n, fine = 0, len(source), True
    while i < n:
        if source.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                if source.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif source.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            i, fine = j, fine and depth == 0
            continue
        raw = source[i] == "r" and source[i + 1 : i + 2] in ("'", '"')
        if raw or source[i] in "'\"":
            tok, inner, ok = _string(source, i, raw)
            out.append(tok)
            out.extend(inner)
            i, fine = tok.end, fine and ok
            continue
        m = _TOKEN.match(source, i)
        if not m:
            i, fine = i + 1, False
            continue
        if m.lastgroup not in ("space", "line"):
            out.append(Token(m.lastgroup, m[0], i, m.end()))
        i = m.end()
    return out, fine


def _string(source: str, start: int, raw: bool) -> tuple[Token, list[Token], bool]:
    i = start + raw
    quote = source[i] * 3 if source.startswith(source[i] * 3, i) else source[i]
    i += len(quote)
    value, inner = [], []
    while i < len(source):
        if source.startswith(quote, i):
            return Token("str", "".join(value), start, i + len(quote)), inner, True
        c = source[i]
        if len(quote) == 1 and c == "\n":
            break
        if c == "\\" and not raw:
            value.append({"n": "\n", "t": "\t", "r": "\r"}.get(source[i + 1 : i + 2], source[i + 1 : i + 2]))
            i += 2
        elif c == "$" and not raw and source.startswith("{", i + 1):
            depth, j = 1, i + 2
            while j < len(source) and depth:
                if source[j] in "'\"":
                    j = _string(source, j, False)[0].end
                    continue
                depth += (source[j] == "{") - (source[j] == "}")
                j += 1
            sub, _ = scan(source[i + 2 : j - 1])
            inner += [Token(t.kind, t.text, t.at + i + 2, t.end + i + 2) for t in sub]
            value.append(source[i:j])
            i = j
        elif c == "$" and not raw and re.match(r"[A-Za-z_]\w*", source[i + 1 :]):
            name = re.match(r"[A-Za-z_]\w*", source[i + 1 :])[0]
            inner.append(Token("id", name, i + 1, i + 1 + len(name)))
            value.append("$" + name)
            i += 1 + len(name)
        else:
            value.append(c)
            i += 1
    return Token("str", "".join(value), start, i), inner, False


class _Parser:
    def __init__(self, source: str):
        self.source = source
        self.t, self.complete = scan(source)
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.match = self._pairs()
        self.out: dict = {k: [] for k in ("directives", "declarations", "members", "supertypes", "functions", "calls", "refs", "routes", "literals")}
        self.library = self.part_of = None

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at) - 1
        return line + 1, len(self.source[self.starts[line] : at].encode())

    def _pairs(self) -> dict[int, int]:
        open_, out = [], {}
        for k, tok in enumerate(self.t):
            if tok.kind == "op" and tok.text in "([{":
                open_.append(k)
            elif tok.kind == "op" and tok.text in ")]}":
                if open_:
                    out[open_.pop()] = k
                else:
                    self.complete = False
        if open_:
            self.complete = False
        return out

    def is_(self, k: int, *texts: str) -> bool:
        return k < len(self.t) and self.t[k].kind != "str" and self.t[k].text in texts

    def id_(self, k: int) -> str | None:
        return self.t[k].text if k < len(self.t) and self.t[k].kind == "id" else None

    def close(self, k: int) -> int:
        return self.match.get(k, len(self.t) - 1)

    def to(self, k: int, *texts: str) -> int:
        """First token at depth 0 that is one of texts."""
        while k < len(self.t) and not self.is_(k, *texts):
            if self.is_(k, ")", "]", "}"):
                return k
            k = self.close(k) + 1 if self.is_(k, "(", "[", "{") else k + 1
        return k

    def metadata(self, k: int) -> int:
        while self.is_(k, "@"):
            k += 2
            while self.is_(k, "."):
                k += 2
            if self.is_(k, "<"):
                k = self.angle(k)
            if self.is_(k, "("):
                k = self.close(k) + 1
        return k

    def angle(self, k: int) -> int:
        """After a type argument list that begins here."""
        depth = 0
        while k < len(self.t):
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if depth == 0:
                    return k + 1
            elif self.is_(k, "(", "[", "{"):
                k = self.close(k)
            elif self.is_(k, ";", ")", "}"):
                return k
            k += 1
        return k

    # top level

    def run(self) -> dict:
        k = 0
        while k < len(self.t):
            start = k
            k = self.metadata(k)
            if k >= len(self.t):
                break
            k = max(self.directive(k) or self.declaration(start, k), k + 1)
        self.leaves()
        return self.out

    def directive(self, k: int) -> int | None:
        kind = self.id_(k)
        if kind not in ("import", "export", "part", "library", "augment"):
            return None
        if kind == "augment" and not (self.is_(k + 1, "library")):
            return None
        at, j = self.t[k].at, k + 1
        if kind == "library" and not self.is_(j, "augment"):
            end = self.to(j, ";")
            self.library = "".join(t.text for t in self.t[j:end])
            return end + 1
        if kind == "part" and self.is_(j, "of"):
            end = self.to(j, ";")
            self.part_of = "".join(t.text for t in self.t[j + 1 : end])
            return end + 1
        if self.is_(j, "augment", "library"):
            kind, j = "augment", j + 1
        if j >= len(self.t) or self.t[j].kind != "str":
            return None
        uris: list[tuple] = [(self.t[j].text, None, None)]
        j += 1
        while self.is_(j, "if") and self.is_(j + 1, "("):
            end = self.close(j + 1)
            cond = self.t[j + 2 : end]
            eq = next((x for x, t in enumerate(cond) if t.text == "=="), len(cond))
            expected = cond[eq + 1].text if eq + 1 < len(cond) else "true"
            j = end + 1
            if j < len(self.t) and self.t[j].kind == "str":
                uris.append((self.t[j].text, "".join(t.text for t in cond[:eq]), expected))
                j += 1
        prefix, deferred, combs = None, False, []
        while j < len(self.t) and not self.is_(j, ";"):
            if self.is_(j, "deferred"):
                deferred = True
            elif self.is_(j, "as"):
                prefix = self.id_(j + 1)
                j += 1
            elif self.is_(j, "show", "hide"):
                names, word = [], self.t[j].text
                while self.id_(j + 1):
                    names.append(self.t[j + 1].text)
                    j += 1
                    if not self.is_(j + 1, ","):
                        break
                    j += 1
                combs.append({"kind": word, "names": names})
            j += 1
        line, col = self.place(at)
        for n, (uri, var, exp) in enumerate(uris):
            self.out["directives"].append({"kind": kind, "ordinal": n, "uri": uri, "variable": var, "expected": exp, "prefix": prefix, "deferred": deferred, "combinators": combs, "line": line, "col": col})
        return j + 1

    def declare(self, kind: str, k: int, start: int, end: int) -> None:
        line, col = self.place(self.t[k].at)
        self.out["declarations"].append({"kind": kind, "name": self.t[k].text, "line": line, "col": col, "start_line": self.place(self.t[start].at)[0], "end_line": self.place(self.t[min(end, len(self.t) - 1)].end - 1)[0]})

    def declaration(self, start: int, k: int) -> int:
        j = k
        while self.is_(j, "abstract", "base", "sealed", "final", "interface", "external", "augment", "late", "const", "var", "covariant") and (self.is_(j + 1, "class", "mixin", "base", "interface", "final", "sealed", "abstract") or not self.is_(j, "final", "base", "sealed", "interface")):
            j += 1
        word = self.id_(j)
        if word == "mixin" and self.is_(j + 1, "class"):
            j += 1
            word = "class"
        if word in ("class", "mixin", "enum", "extension") and (self.id_(j + 1) or word == "extension"):
            return self.class_like(start, j, word)
        if word == "typedef":
            end = self.to(j, ";")
            eq = next((x for x in range(j, end) if self.is_(x, "=")), None)
            names = [x for x in range(j + 1, eq if eq else end) if self.t[x].kind == "id"]
            if names:
                name = names[0] if eq else next((x for x in names if self.is_(x + 1, "(")), names[-1])
                self.declare("type-alias", name, start, end)
            return end + 1
        return self.callable_or_fields(start, k, None)

    def class_like(self, start: int, j: int, word: str) -> int:
        kind = word
        j += 1
        if word == "extension" and self.is_(j, "type"):
            kind, j = "extension-type", j + 1
            if self.is_(j, "const"):
                j += 1
        name = j if self.id_(j) and not self.is_(j, "on") else None
        body = self.to(j, "{", ";")
        end = self.close(body) if self.is_(body, "{") else body
        owner = self.t[name].text if name is not None else ""
        if name is not None:
            self.declare(kind, name, start, end)
        clause, x = None, j + (name is not None)
        while x < body:
            if self.is_(x, "extends", "with", "implements", "on"):
                clause = self.t[x].text
            elif clause and self.id_(x) and (self.is_(x - 1, "extends", "with", "implements", "on", ",")):
                full = x
                while self.is_(full + 1, ".") and self.id_(full + 2):
                    full += 2
                self.out["supertypes"].append({"owner": owner, "clause": clause, "name": "".join(t.text for t in self.t[x : full + 1])})
                x = full
            elif self.is_(x, "<"):
                x = self.angle(x) - 1
            elif self.is_(x, "("):
                x = self.close(x)
            x += 1
        if self.is_(body, "{"):
            x = body + 1
            if word == "enum":
                x = self.enum_constants(owner, x, end)
            while x < end:
                s = x
                x = self.metadata(x)
                if x >= end:
                    break
                x = max(self.callable_or_fields(s, x, owner, end), x + 1)
        return end + 1

    def enum_constants(self, owner: str, x: int, end: int) -> int:
        while x < end:
            x = self.metadata(x)
            if self.is_(x, ";"):
                return x + 1
            if self.id_(x):
                self.member(owner, "enum-constant", x, False)
            x = self.to(x, ",", ";")
            if self.is_(x, ","):
                x += 1
        return x

    def member(self, owner: str, kind: str, k: int, body: bool, name: str | None = None) -> None:
        line, col = self.place(self.t[k].at)
        self.out["members"].append({"owner": owner, "kind": kind, "name": name or self.t[k].text, "has_body": body, "line": line, "col": col})

    def callable_or_fields(self, start: int, k: int, owner: str | None, end: int | None = None) -> int:
        """A function, method, accessor, constructor, or variables, from here to its end."""
        end = len(self.t) if end is None else end
        j, last, accessor = k, None, None
        while j < end:
            if self.is_(j, ";", "=", ",", "}"):
                break
            if self.is_(j, "<"):
                j = self.angle(j)
                continue
            if self.is_(j, "get", "set") and self.id_(j + 1) and not self.is_(j + 1, "("):
                accessor = self.t[j].text
            elif self.is_(j, "operator") and not self.is_(j + 1, "(", "=", ";"):
                name = j + 1
                op = self.t[name].text + (self.t[name + 1].text if self.is_(name, "[") else "")
                params = self.to(name + (2 if self.is_(name, "[") else 1), "(")
                return self.body(start, name, params, owner, "operator", op, end)
            elif self.is_(j, "(") and last is not None:
                ctor = owner is not None and (self.t[last].text == owner or self.is_(last - 1, ".") and self.id_(last - 2) == owner)
                kind = "constructor" if ctor else "method" if owner is not None else "function"
                if not (self.id_(self.close(j) + 1) and not self.is_(self.close(j) + 1, "async", "sync", "native")):
                    return self.body(start, last, j, owner, accessor or kind, None, end)
                j = self.close(j)  # a record or function type
            elif self.is_(j, "(", "[", "{"):
                if self.is_(j, "{") and last is not None and accessor:
                    return self.body(start, last, None, owner, accessor, None, end, j)
                j = self.close(j)
            elif self.is_(j, "=>"):
                return self.body(start, last if last is not None else k, None, owner, accessor or "method", None, end, j)
            elif self.id_(j):
                last = j
            j += 1
        stop = j
        while stop < end and not self.is_(stop, ";"):
            stop = self.close(stop) + 1 if self.is_(stop, "(", "[", "{") else stop + 1
        if last is not None and not self.is_(last, *_KEYWORDS):
            names, x = [last], j
            while x < stop:
                if self.is_(x, ",") and self.id_(x + 1) and self.is_(x + 2, ",", ";", "="):
                    names.append(x + 1)
                x = self.close(x) + 1 if self.is_(x, "(", "[", "{", "<") and x in self.match else x + 1
            for n in names:
                if owner is None:
                    self.declare("variable", n, start, stop)
                elif accessor:
                    self.member(owner, "getter" if accessor == "get" else "setter", n, False)
                else:
                    self.member(owner, "field", n, False)
        elif last is None:
            self.complete = False
        return stop + 1

    def body(self, start: int, name: int, params: int | None, owner: str | None, kind: str, label: str | None, end: int, at: int | None = None) -> int:
        j = at if at is not None else self.close(params) + 1
        while j < end and not self.is_(j, "{", "=>", ";", "}"):
            if self.is_(j, "("):
                j = self.close(j)
            j += 1
        has = self.is_(j, "{", "=>")
        stop = self.close(j) if self.is_(j, "{") else self.to(j, ";") if has else j
        kind = {"get": "getter", "set": "setter"}.get(kind, kind)
        symbol = label or self.t[name].text
        if owner is None:
            self.declare("function", name, start, stop)
        else:
            self.member(owner, kind, name, has, label)
        if has:
            self.score(symbol if owner is None else f"{owner}.{symbol}", kind, owner, name, j, stop)
        return stop + 1

    # complexity

    def score(self, symbol: str, kind: str, owner: str | None, name: int, j: int, stop: int) -> None:
        self.cyc, self.cog = 1, 0
        closures: list[tuple[int, int, int]] = []
        self.walk(j + 1, stop, 0, closures)
        line, col = self.place(self.t[name].at)
        self.out["functions"].append({"symbol": symbol, "kind": kind, "owner": owner, "line": line, "col": col, "end_line": self.place(self.t[min(stop, len(self.t) - 1)].end - 1)[0], "cyclomatic": self.cyc, "cognitive": self.cog})
        for head, a, b in closures:
            self.score("<closure>", "closure", owner, head, a, b)

    def decide(self, nesting: int) -> None:
        self.cyc += 1
        self.cog += 1 + nesting

    def statement_end(self, j: int, stop: int) -> int:
        """Last token of the statement that begins here."""
        if self.is_(j, "{"):
            return self.close(j)
        if self.is_(j, "if", "for", "while", "switch") or self.is_(j, "await") and self.is_(j + 1, "for"):
            p = self.to(j, "(")
            e = self.statement_end(self.close(p) + 1, stop)
            while self.is_(j, "if") and self.is_(e + 1, "else"):
                e = self.statement_end(e + 2, stop)
            return e
        return min(self.to(j, ";"), stop)

    def walk(self, j: int, stop: int, nesting: int, closures: list) -> None:
        logical: dict[int, str] = {}
        depth = 0
        while j < stop:
            tok = self.t[j]
            if tok.kind == "id" and tok.text in ("if", "for", "while") and self.is_(j + 1, "("):
                self.decide(nesting)
                end = self.close(j + 1)
                self.walk(j + 2, end, nesting, closures)
                last = self.statement_end(end + 1, stop)
                self.walk(end + 1, last + 1, nesting + 1, closures)
                j = last + 1
                if tok.text == "if" and self.is_(j, "else"):
                    j += 1
                continue
            if tok.kind == "id" and tok.text == "do" and self.is_(j + 1, "{"):
                self.decide(nesting)
                end = self.close(j + 1)
                self.walk(j + 2, end, nesting + 1, closures)
                j = self.to(end, ";") if self.is_(end + 1, "while") else end
            elif tok.kind == "id" and tok.text == "catch" and self.is_(j + 1, "("):
                self.decide(nesting)
                body = self.close(j + 1) + 1
                if self.is_(body, "{"):
                    self.walk(body + 1, self.close(body), nesting + 1, closures)
                    j = self.close(body)
            elif tok.kind == "id" and tok.text == "case":
                self.cyc += 1
                self.cog += 1
            elif tok.kind == "op" and tok.text in ("(", "[", "{"):
                end = self.close(j)
                after = end + 1
                while self.is_(after, "async", "sync", "*"):
                    after += 1
                closure = tok.text == "(" and self.is_(after, "{", "=>") and not self.is_(j - 1, "switch", "while", "if", "for", "catch")
                if closure:
                    b = self.close(after) if self.is_(after, "{") else self.expression_end(after, stop)
                    closures.append((j, after, b))
                    j = b if self.is_(after, "{") else b - 1
                else:
                    self.walk(j + 1, end, nesting, closures)
                    j = end
            elif tok.kind == "op" and tok.text in ("&&", "||", "??"):
                self.cyc += 1
                if logical.get(depth) != tok.text:
                    self.cog += 1
                logical[depth] = tok.text
            elif tok.kind == "op" and tok.text == "?" and self.ternary(j, stop):
                self.decide(nesting)
                logical.pop(depth, None)
            elif tok.kind == "op" and tok.text in (";", ",", "{"):
                logical.pop(depth, None)
            j += 1

    def expression_end(self, j: int, stop: int) -> int:
        while j < stop and not self.is_(j, ",", ";", ")", "]", "}"):
            j = self.close(j) + 1 if self.is_(j, "(", "[", "{") else j + 1
        return j

    def ternary(self, j: int, stop: int) -> bool:
        """A question mark with a colon of its own before the expression ends."""
        if self.is_(j + 1, ")", ">", ",", ";", "=", "]", ".") or self.id_(j + 1) and self.is_(j + 2, "=", ";", ",", ")") and not self.is_(j + 1, "true", "false", "null"):
            return False
        depth, x = 0, j + 1
        while x < stop and not self.is_(x, ";", ",", ")", "]", "}"):
            if self.is_(x, "(", "[", "{"):
                x = self.close(x)
            elif self.is_(x, "?"):
                depth += 1
            elif self.is_(x, ":"):
                if depth == 0:
                    return True
                depth -= 1
            x += 1
        return False

    # flat facts

    def leaves(self) -> None:
        declared = {(d["line"], d["col"]) for d in self.out["declarations"]} | {(m["line"], m["col"]) for m in self.out["members"] if m["kind"] != "operator"}
        seen = set()
        for k, tok in enumerate(self.t):
            if tok.kind == "str":
                line, col = self.place(tok.at)
                self.out["literals"].append({"value": tok.text, "line": line, "col": col})
            if tok.kind != "id" or tok.text in _KEYWORDS:
                continue
            line, col = self.place(tok.at)
            dotted = self.is_(k - 1, ".", "?.", "..", "?..") and k > 0
            qualifier = self.id_(k - 2) if dotted and k > 1 else None
            if (line, col) not in declared and (line, col, tok.text) not in seen:
                seen.add((line, col, tok.text))
                short = dotted and qualifier is None and self.is_(k - 1, ".") and (k < 2 or not (self.is_(k - 2, ")", "]", "}", ">") or self.t[k - 2].kind == "str"))
                self.out["refs"].append({"name": tok.text, "qualifier": "<shorthand>" if short else qualifier, "line": line, "col": col})
            after = self.angle(k + 1) if self.is_(k + 1, "<") else k + 1
            if self.is_(after, "(") and tok.text not in _NOT_CALLS and (line, col) not in declared:
                x = k
                while self.is_(x - 1, ".") and self.id_(x - 2):
                    x -= 2
                self.out["calls"].append({"callee": "".join(t.text for t in self.t[x : k + 1]), "line": line, "col": col})
                if tok.text in _ROUTES:
                    args = self.named_strings(after)
                    if args.get("path") is not None:
                        self.out["routes"].append({"route_class": tok.text, "route_path": args["path"], "name": args.get("name"), "line": line, "col": col})

    def named_strings(self, k: int) -> dict[str, str]:
        out, x, end = {}, k + 1, self.close(k)
        while x < end:
            if self.id_(x) and self.is_(x + 1, ":") and x + 2 < end and self.t[x + 2].kind == "str":
                out[self.t[x].text] = self.t[x + 2].text
            x = self.close(x) + 1 if self.is_(x, "(", "[", "{") else x + 1
        return out


def facts(source: str) -> dict:
    """All facts of one source."""
    p = _Parser(source)
    out = p.run()
    return {"complete": p.complete, "library": p.library, "part_of": p.part_of, "line_count": source.count("\n") + 1, **out}


def extract(files: DataFrame) -> DataFrame:
    """One row of nested facts a file. Cheap filters belong before this: none passes it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": path, **facts(source or "")} for path, source in zip(b["path"], b["source"])])

    return files.select("path", "source").mapInPandas(run, SCHEMA)


def fact(extracted: DataFrame, name: str) -> DataFrame:
    """One kind of fact as a table: a row a fact with its path."""
    return extracted.select("path", F.explode(name).alias("f")).select("path", "f.*")


def edges(extracted: DataFrame, package: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolved edges and unresolved local ones.

    Relative uris and ``package:`` uris of the own package are local; other
    schemes are dropped. Each edge has src, dst, kind, uri, line, col, prefix and
    combinators; parallel edges stay.
    """
    from graphloom.functions.scalars import normalized_path
    from graphloom.sources.readers import percent_decoded

    d = fact(extracted, "directives")
    uri = percent_decoded(F.col("uri"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    own = F.lit(f"package:{package}/") if package else F.lit("package:/")
    target = F.when(F.startswith(uri, own), F.concat(F.lit("lib/"), F.substring(uri, F.length(own) + 1, F.length(uri)))).when(~uri.rlike("^[a-z][a-z0-9+.-]*:"), F.concat(folder, uri))
    local = d.withColumn("dst", normalized_path(target)).where("dst IS NOT NULL").withColumnRenamed("path", "src")
    known = extracted.select(F.col("path").alias("dst"))
    cols = ["src", "dst", "kind", "uri", "line", "col", "prefix", "combinators"]
    return local.join(known, "dst", "left_semi").select(cols), local.join(known, "dst", "left_anti").select(cols)
