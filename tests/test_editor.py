"""The language server, over pipes in memory."""

import io
import json

from textloom.editor import Server, tokens

SOURCE = "ALIAS sep = ', '\nrec = k:WORD sep v:INT WHERE v = 'é😀x' OR k = 'a' AS { k: v }\nTEXT = 1 TO n rec SPLITBY NL\n"


def talk(*messages, source=SOURCE):
    opened = {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": "q", "text": source}}}
    raw = b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(m), m) for m in (json.dumps(x).encode() for x in (opened, *messages, {"id": 99, "method": "shutdown"}, {"method": "exit"})))
    out = io.BytesIO()
    assert Server(io.BytesIO(raw), out).serve() == 0
    replies = [json.loads(part.split(b"\r\n\r\n", 1)[-1]) for part in _parts(out.getvalue())]
    return replies


def _parts(raw):
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        size = int(head.split(b":")[1])
        yield rest[:size]
        raw = rest[size:]


def ask(method, line=0, character=0, source=SOURCE, **more):
    params = {"textDocument": {"uri": "q"}, "position": {"line": line, "character": character}} | more
    return next(r for r in talk({"id": 1, "method": method, "params": params}, source=source) if r.get("id") == 1)


def test_diagnostics():
    assert talk()[0]["params"]["diagnostics"] == []
    found = talk(source="TEXT = wrod\nword2 = WORD")[0]["params"]["diagnostics"]
    assert [d["code"] for d in found] == ["loom::check::undefined_rule"] and found[0]["range"]["start"] == {"line": 0, "character": 7}


def test_names():
    assert ask("textDocument/definition", 2, 14)["result"]["range"]["start"] == {"line": 1, "character": 0}
    assert [r["range"]["start"] for r in ask("textDocument/references", 0, 7)["result"]] == [{"line": 0, "character": 6}, {"line": 1, "character": 13}]
    assert len(ask("textDocument/documentHighlight", 1, 6)["result"]) == 3
    edits = ask("textDocument/rename", 2, 14, newName="item")["result"]["changes"]["q"]
    assert [e["range"]["start"]["line"] for e in edits] == [1, 2]
    assert "error" in ask("textDocument/rename", 2, 14, newName="WORD") and "error" in ask("textDocument/rename", 2, 14, newName="sep")
    assert ask("textDocument/prepareRename", 1, 9)["result"] is None
    assert [x["name"] for x in ask("textDocument/documentSymbol")["result"]] == ["sep", "rec", "TEXT"]
    assert "a whole run" in ask("textDocument/hover", 1, 9)["result"]["contents"]["value"]
    assert {"rec", "k", "WORD", "SPLITBY", "JOIN"} <= {x["label"] for x in ask("textDocument/completion")["result"]}
    assert ask("textDocument/none")["error"]["code"] == -32601


def test_tokens_of_broken_texts():
    assert [t.text for t in tokens("TEXT = | WORD 'open")][:3] == ["TEXT", "=", "WORD"]
    data = ask("textDocument/semanticTokens/full")["result"]["data"]
    assert len(data) % 5 == 0 and data[:5] == [0, 0, 5, 0, 0]
    for broken in ("", "'", "TEXT = (((", "a.b = = :", "\\", "é😀 'x\ny'"):
        assert "result" in ask("textDocument/semanticTokens/full", source=broken)
