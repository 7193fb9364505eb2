"""A language server over standard input and output: diagnostics, tokens, definition, references, highlight, rename, hover, completion, symbols.

It works on tokens, so it also helps in texts that do not parse.  Positions are lines and UTF-16 units, as the protocol counts.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right

from .functions.values import FUNCTIONS
from .plans import syntax as s
from .plans.checks import Checker
from .plans.diagnostics import Problem, QueryError

TOKEN_TYPES = ("keyword", "type", "function", "variable", "parameter", "string", "number", "operator", "macro")
ABOUT = {
    "WORD": "a whole run of letters", "INT": "a whole run of digits", "FLOAT": "digits with an optional fraction", "HEX": "a run of hexadecimal digits", "BIN": "a run of 0 and 1", "IPV4": "a dotted address",
    "IPV6": "an IPv6 address", "PUNCT": "one sign", "ANY": "any one character", "DIGIT": "one digit", "LETTER": "one letter", "LINE": "a whole line without its break", "NL": "one line break", "TAB": "a tab",
    "ROW": "the line number", "COL": "the column", "EOF": "the end of the text",
}


def tokens(source: str) -> list[s.Token]:
    """Tokens of a text that may not be well formed: what cannot be read is skipped."""
    out: list[s.Token] = []
    at = 0
    while True:
        try:
            own = s.tokens(source[at:])
        except QueryError as error:
            p = error.problems[0]
            good = source[at : at + p.start]
            try:
                own = s.tokens(good)
            except QueryError:
                own = []
            out += [s.Token(t.kind, t.text, t.start + at, t.end + at, t.value) for t in own if t.kind != "end"]
            at += max(p.end, p.start + 1)
            if at >= len(source):
                return out
            continue
        return out + [s.Token(t.kind, t.text, t.start + at, t.end + at, t.value) for t in own if t.kind != "end"]


class Document:
    def __init__(self, source: str):
        self.source = source
        self.lines = [0, *(i + 1 for i, c in enumerate(source) if c == "\n" or c == "\r" and source[i + 1 : i + 2] != "\n")]
        self.tokens = tokens(source)
        self.definitions: dict[str, s.Token] = {}
        self.roles: list[str] = []  # of each token
        for i, t in enumerate(self.tokens):
            after = self.tokens[i + 1] if i + 1 < len(self.tokens) else None
            before = self.tokens[i - 1] if i else None
            sign = after.text if after is not None and after.kind == "sign" else ""
            role = {"string": "string", "number": "number", "sign": "operator"}.get(t.kind, "variable")
            if t.kind == "keyword":
                role = "type" if t.value in s.PRIMITIVES else "keyword"
            elif t.kind == "name":
                alias = before is not None and before.kind == "keyword" and before.value == "ALIAS"
                if before is not None and before.kind == "sign" and before.text == ".":
                    role = "field"
                elif sign == "=" and not self._compares(i):
                    role = "macro" if alias else "function"
                    self.definitions.setdefault(t.text, t)
                elif sign == ":":
                    role = "parameter"
            self.roles.append(role)
        self.problems = self.check()

    def _compares(self, i: int) -> bool:
        """Whether the ``=`` after token ``i`` is a comparison: the token stands where a value of a condition begins."""
        before = self.tokens[i - 1] if i else None
        return before is not None and (before.kind == "keyword" and before.value in ("WHERE", "AND", "OR", "NOT") or before.kind == "sign" and before.text not in (")", "]", "}"))

    def check(self) -> list[Problem]:
        try:
            return Checker(s.parse(self.source), self.source).check()
        except QueryError as error:
            return error.problems

    # positions

    def position(self, at: int) -> dict:
        line = bisect_right(self.lines, at) - 1
        return {"line": line, "character": len(self.source[self.lines[line] : at].encode("utf-16-le")) // 2}

    def offset(self, position: dict) -> int:
        if position["line"] >= len(self.lines):
            return len(self.source)
        at, units = self.lines[position["line"]], position["character"]
        end = self.lines[position["line"] + 1] if position["line"] + 1 < len(self.lines) else len(self.source)
        while units > 0 and at < end:
            units -= 2 if ord(self.source[at]) > 0xFFFF else 1
            at += 1
        return at

    def span(self, start: int, end: int) -> dict:
        return {"start": self.position(start), "end": self.position(end)}

    def at(self, position: dict) -> tuple[int, s.Token] | None:
        offset = self.offset(position)
        return next(((i, t) for i, t in enumerate(self.tokens) if t.start <= offset <= t.end and t.kind in ("name", "keyword")), None)

    def named(self, position: dict) -> list[s.Token]:
        """All uses of the name at a position; fields after a dot are names of the data, not of the query."""
        found = self.at(position)
        if found is None or found[1].kind != "name" or self.roles[found[0]] == "field":
            return []
        same = (lambda n: n.upper() == "TEXT") if found[1].text.upper() == "TEXT" and "TEXT" in map(str.upper, self.definitions) else (lambda n: n == found[1].text)
        return [t for t, role in zip(self.tokens, self.roles, strict=True) if t.kind == "name" and role != "field" and same(t.text)]


class Server:
    def __init__(self, read, write):
        self.read, self.write = read, write
        self.documents: dict[str, Document] = {}
        self.stopping = False

    def send(self, message: dict) -> None:
        raw = json.dumps({"jsonrpc": "2.0"} | message).encode()
        self.write.write(b"Content-Length: %d\r\n\r\n" % len(raw) + raw)
        self.write.flush()

    def serve(self) -> int:
        while True:
            length = None
            while (line := self.read.readline()) not in (b"\r\n", b"\n"):
                if not line:
                    return 1
                if line.lower().startswith(b"content-length:"):
                    length = int(line.split(b":")[1])
            message = json.loads(self.read.read(length or 0) or b"{}")
            method, given = message.get("method"), message.get("params") or {}
            if method == "exit":
                return 0 if self.stopping else 1
            if "id" in message and method:
                handler = HANDLERS.get(method)
                if handler is None:
                    self.send({"id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}})
                else:
                    try:
                        self.send({"id": message["id"], "result": handler(self, given)})
                    except ValueError as error:
                        self.send({"id": message["id"], "error": {"code": -32602, "message": str(error)}})
            elif method in ("textDocument/didOpen", "textDocument/didChange"):
                own = given["textDocument"]
                self.update(own["uri"], own["text"] if method.endswith("Open") else given["contentChanges"][-1]["text"])
            elif method == "textDocument/didClose":
                self.documents.pop(given["textDocument"]["uri"], None)
                self.send({"method": "textDocument/publishDiagnostics", "params": {"uri": given["textDocument"]["uri"], "diagnostics": []}})

    def update(self, uri: str, source: str) -> None:
        own = self.documents[uri] = Document(source)
        found = [{"range": own.span(p.start, p.end), "severity": 2 if p.severity == "warning" else 1, "code": p.code, "source": "textloom", "message": p.message + (f"\nhelp: {p.help}" if p.help else "")} for p in own.problems]
        self.send({"method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": found}})

    def document(self, given: dict) -> Document:
        try:
            return self.documents[given["textDocument"]["uri"]]
        except KeyError:
            raise ValueError("the document is not open") from None

    # requests

    def initialize(self, given: dict) -> dict:
        can = {"textDocumentSync": 1, "definitionProvider": True, "referencesProvider": True, "documentHighlightProvider": True, "renameProvider": {"prepareProvider": True}, "hoverProvider": True, "completionProvider": {}, "documentSymbolProvider": True}
        can["semanticTokensProvider"] = {"legend": {"tokenTypes": list(TOKEN_TYPES), "tokenModifiers": []}, "full": True}
        return {"capabilities": can, "serverInfo": {"name": "textloom"}}

    def shutdown(self, given: dict) -> None:
        self.stopping = True

    def semantic_tokens(self, given: dict) -> dict:
        own, data, before = self.document(given), [], (0, 0)
        for t, role in zip(own.tokens, own.roles, strict=True):
            kind = TOKEN_TYPES.index("variable" if role == "field" else role)
            at = t.start
            for piece in t.text.splitlines(keepends=True):  # strings may span lines
                p = own.position(at)
                size = len(piece.rstrip("\r\n").encode("utf-16-le")) // 2
                if size:
                    line = p["line"] - before[0]
                    data += [line, p["character"] - (0 if line else before[1]), size, kind, 0]
                    before = (p["line"], p["character"])
                at += len(piece)
        return {"data": data}

    def definition(self, given: dict) -> dict | None:
        own = self.document(given)
        names = own.named(given["position"])
        t = own.definitions.get(names[0].text) if names else None
        return t and {"uri": given["textDocument"]["uri"], "range": own.span(t.start, t.end)}

    def references(self, given: dict) -> list:
        own = self.document(given)
        keep = given.get("context", {}).get("includeDeclaration", True)
        return [{"uri": given["textDocument"]["uri"], "range": own.span(t.start, t.end)} for t in own.named(given["position"]) if keep or t is not own.definitions.get(t.text)]

    def highlight(self, given: dict) -> list:
        own = self.document(given)
        return [{"range": own.span(t.start, t.end)} for t in own.named(given["position"])]

    def prepare_rename(self, given: dict) -> dict | None:
        own = self.document(given)
        found = own.at(given["position"])
        return own.span(found[1].start, found[1].end) if found and own.named(given["position"]) else None

    def rename(self, given: dict) -> dict | None:
        own, new = self.document(given), given["newName"]
        try:
            read = s.tokens(new)
        except QueryError:
            read = []
        if len(read) != 2 or read[0].kind != "name" or read[0].value in ("TRUE", "FALSE", "NULL"):
            raise ValueError(f"`{new}` cannot be a name")
        if new in own.definitions:
            raise ValueError(f"`{new}` is defined already")
        names = own.named(given["position"])
        return {"changes": {given["textDocument"]["uri"]: [{"range": own.span(t.start, t.end), "newText": new} for t in names]}} if names else None

    def hover(self, given: dict) -> dict | None:
        own = self.document(given)
        found = own.at(given["position"])
        if found is None:
            return None
        _, t = found
        text = None
        if t.kind == "keyword" and t.value in ABOUT:
            text = f"**{t.value}**: {ABOUT[t.value]}"
        elif t.text in own.definitions:
            begin = own.definitions[t.text]
            text = f"```\n{own.source[begin.start :].splitlines()[0]}\n```"
        elif t.text.upper() in FUNCTIONS:
            text = f"**{t.text.upper()}**: a function of {FUNCTIONS[t.text.upper()]} value(s)"
        return text and {"contents": {"kind": "markdown", "value": text}, "range": own.span(t.start, t.end)}

    def completion(self, given: dict) -> list:
        own = self.document(given)
        labels = {t.text for t, role in zip(own.tokens, own.roles, strict=True) if role == "parameter"}
        kinds = [(own.definitions, 3), (labels, 6), (s.PRIMITIVES, 21), (s.KEYWORDS, 14), (FUNCTIONS, 2)]
        return [{"label": n, "kind": kind} for names, kind in kinds for n in sorted(names)]

    def symbols(self, given: dict) -> list:
        own = self.document(given)
        starts = sorted(own.definitions.values(), key=lambda t: t.start)
        ends = [*(t.start for t in starts[1:]), len(own.source)]
        return [{"name": t.text, "kind": 12, "range": own.span(t.start, t.start + len(own.source[t.start : e].rstrip())), "selectionRange": own.span(t.start, t.end)} for t, e in zip(starts, ends, strict=True)]


HANDLERS = {
    "initialize": Server.initialize, "shutdown": Server.shutdown, "textDocument/semanticTokens/full": Server.semantic_tokens, "textDocument/definition": Server.definition,
    "textDocument/references": Server.references, "textDocument/documentHighlight": Server.highlight, "textDocument/prepareRename": Server.prepare_rename, "textDocument/rename": Server.rename,
    "textDocument/hover": Server.hover, "textDocument/completion": Server.completion, "textDocument/documentSymbol": Server.symbols,
}


def main() -> int:
    return Server(sys.stdin.buffer, sys.stdout.buffer).serve()
