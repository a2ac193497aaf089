"""A small web page that builds a command line from a form and runs it in a process of its own."""

from __future__ import annotations

import html
import subprocess
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

#: The fields of each command's form; a question mark stands for a switch.
FORMS = {
    "convert": ["source", "--output", "--format", "--overwrite?", "--with-layout?", "--dry-run?"],
    "extract": ["source", "--output", "--threshold", "--min-score", "--simhash?", "--merge?", "--keep-deprecated?", "--dry-run?"],
    "export": ["source", "--target", "--output", "--vault", "--api-url", "--workspace", "--db", "--dedup?", "--consolidate?"],
    "pipeline": ["source", "--output", "--threshold", "--min-score", "--simhash?", "--merge?", "--target", "--vault", "--incremental?"],
}


def argv(command: str, values: dict[str, str]) -> list[str]:
    """The command line that a form's values stand for; empty values and unknown fields are left out."""
    if command not in FORMS or not values.get("source"):
        raise ValueError("a known command and a source are needed")
    out = [command, values["source"]]
    for field in FORMS[command][1:]:
        name, switch = field.rstrip("?"), field.endswith("?")
        value = values.get(name, "").strip()
        if value:
            out += [name] if switch else [f"{name}={value}"]
    return out


def execute(arguments: list[str], timeout: int = 3600) -> tuple[int, str]:
    """Exit code and output of a command; no shell is involved."""
    done = subprocess.run([sys.executable, "-m", "sedimenta", *arguments], capture_output=True, text=True, timeout=timeout, check=False)
    return done.returncode, done.stdout + (done.stderr[-2000:] if done.returncode else "")


def page(result: str = "") -> str:
    """The page with a form for each command."""
    forms = []
    for command, fields in FORMS.items():
        inputs = "".join(f'<label>{f.rstrip("?").lstrip("-")} <input name="{f.rstrip("?")}"{" type=checkbox value=1" if f.endswith("?") else ""}></label><br>' for f in fields)
        forms.append(f'<h2>{command}</h2><form method="post" action="/{command}">{inputs}<button>run</button></form>')
    return f"<!doctype html><meta charset=utf-8><title>sedimenta</title>{''.join(forms)}<pre>{html.escape(result)}</pre>"


class Handler(BaseHTTPRequestHandler):
    """Shows the forms and runs what is sent."""

    run = staticmethod(execute)

    def _answer(self, code: int, body: str) -> None:
        data = body.encode()
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        self._answer(200, page())

    def do_POST(self) -> None:
        sent = parse_qs(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode())
        try:
            code, output = self.run(argv(self.path.strip("/"), {k: v[0] for k, v in sent.items()}))
            self._answer(200, page(f"exit code {code}\n{output}"))
        except ValueError as failure:
            self._answer(400, page(str(failure)))

    def log_message(self, *_) -> None:
        pass


def serve(port: int = 7860, host: str = "127.0.0.1") -> None:
    """Serves the page until it is interrupted."""
    ThreadingHTTPServer((host, port), Handler).serve_forever()
