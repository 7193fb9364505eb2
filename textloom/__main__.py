"""Command line: ``python -m textloom [run] QUERY [INPUT]`` and ``python -m textloom check QUERY [SAMPLE]``; ``python -m textloom lsp`` serves editors.

``QUERY`` is a file, or ``-e TEXT`` gives the query itself; ``INPUT`` is a file, ``-`` or nothing for standard input.  Results go to standard output,
problems to standard error.  Exit codes: 0, 1 for an error, 2 if ``check`` found an ambiguity or a repeated key.
"""

from __future__ import annotations

import argparse
import os
import sys

from .functions.json_text import to_json
from .operators import kernel
from .operators.extract import compile
from .plans.diagnostics import Problem, QueryError, RunError


def read(path: str | None) -> str:
    if path in (None, "-"):
        raw, name = sys.stdin.buffer.read(), "<stdin>"
    else:
        with open(path, "rb") as file:
            raw, name = file.read(), path
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as error:
        raise RunError([Problem("loom::io::utf8", f"{name} is not UTF-8, at byte {error.start}")]) from None


def say(problems: list[Problem], query: str, text: str | None) -> None:
    for p in problems:
        print(p.render(p.source, query if p.source == "query" else text), file=sys.stderr)


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if arguments == ["lsp"]:
        from .editor import main as serve

        return serve()
    if not arguments or arguments[0] not in ("run", "check", "-h", "--help"):
        arguments = ["run", *arguments]
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "check"):
        command = commands.add_parser(name)
        command.add_argument("-e", dest="inline", metavar="QUERY")
        command.add_argument("files", nargs="*")
        command.add_argument("--max-steps", type=int, default=kernel.Options.max_steps)
        command.add_argument("--max-depth", type=int, default=kernel.Options.max_depth)
        if name == "run":
            command.add_argument("--strict", action="store_true")
            command.add_argument("--compact", action="store_true")
            command.add_argument("--no-ambiguity-check", action="store_true")
    own = parser.parse_args(arguments)
    files = list(own.files)
    if own.inline is None and not files or len(files) > (1 if own.inline is not None else 2):
        parser.error("give one query and at most one input")
    query = text = None
    try:
        query = own.inline if own.inline is not None else read(files.pop(0))
        compiled = compile(query)
        say(compiled.warnings, query, None)
        if own.command == "check" and not files:
            print(f"query OK ({len(compiled.tree.rules)} rules)")
            return 0
        text = read(files[0] if files else None)
        limits = {"max_steps": own.max_steps, "max_depth": own.max_depth}
        if own.command == "check":
            out = compiled.run(text, ambiguity_steps=1 << 62, **limits)
        else:
            out = compiled.run(text, strict=own.strict, check_ambiguity=not own.no_ambiguity_check, **limits)
        say([kernel.repeated_problem(k) for k in out.repeated_keys], query, text)
        say([kernel.ambiguity_problem(a) for a in out.ambiguities], query, text)
        if own.command == "check":
            print(f"query OK ({len(compiled.tree.rules)} rules), sample OK")
            return 2 if out.ambiguities or out.repeated_keys else 0
        if not own.no_ambiguity_check and not out.ambiguity_check_complete:
            print("note: the ambiguity check was not completed", file=sys.stderr)
        print(to_json(out.value, None if own.compact else 2))
        return 0
    except (QueryError, RunError) as error:
        say(error.problems, query or "", text)
    except OSError as error:
        say([Problem("loom::io", str(error))], "", None)
    return 1


if __name__ == "__main__":
    try:
        code = main()
        sys.stdout.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        code = 0
    sys.exit(code)
