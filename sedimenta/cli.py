"""The command line: convert, extract, export, pipeline, retry-slide and webui."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from sedimenta.plans import pipeline
from sedimenta.session import local_session
from sedimenta.sources import config, recognition


def parser() -> argparse.ArgumentParser:
    """All commands with their options and defaults."""
    top = argparse.ArgumentParser(prog="sedimenta", description=__doc__)
    top.add_argument("--version", action="version", version="sedimenta 0.2")
    top.add_argument("--log-level", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    top.add_argument("--cores", default="*", help="threads of the local session, if none is running")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, place: str, *groups) -> None:
        one = commands.add_parser(name)
        one.add_argument(place)
        one.add_argument("-v", "--verbose", action="store_true")
        for group in groups:
            group(one)

    def converting(p: argparse.ArgumentParser) -> None:
        p.add_argument("--format", action="append", dest="formats")
        p.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--with-layout", action="store_true")
        p.add_argument("--ocr", choices=["cloud", "local", "slide", "hybrid"])
        model(p)

    def model(p: argparse.ArgumentParser) -> None:
        for name in ("--ocr-api-url", "--ocr-api-key", "--ocr-model"):
            p.add_argument(name, default="")

    def extracting(p: argparse.ArgumentParser) -> None:
        p.add_argument("--threshold", type=float, default=0.85)
        p.add_argument("--min-score", type=int, default=30)
        for name in ("--simhash", "--merge", "--keep-deprecated"):
            p.add_argument(name, action="store_true")

    def exporting(p: argparse.ArgumentParser, default: str | None = "markdown") -> None:
        p.add_argument("-t", "--target", choices=["obsidian", "markdown", "notes"], default=default)
        for name in ("--vault", "--api-url", "--api-key", "--db"):
            p.add_argument(name)
        p.add_argument("--workspace", default="default")
        p.add_argument("--dedup", action="store_true")
        p.add_argument("--consolidate", action="store_true")

    out = lambda p: p.add_argument("-o", "--output")
    dry = lambda p: p.add_argument("--dry-run", action="store_true")
    command("convert", "source", out, converting, dry)
    command("extract", "source", out, extracting, dry)
    command("export", "source", out, exporting)
    command("pipeline", "source", out, converting, extracting, lambda p: exporting(p, None), lambda p: p.add_argument("--temp-dir"), lambda p: p.add_argument("--incremental", action="store_true"))
    command("retry-slide", "source", model)
    web = commands.add_parser("webui")
    web.add_argument("--port", type=int, default=7860)
    web.add_argument("--share", action="store_true")
    return top


def client(args: argparse.Namespace) -> recognition.Client | None:
    """The recognition that the options, over the settings file, ask for."""
    settings = config.load().recognition
    if getattr(args, "ocr", None):
        settings.enabled, settings.mode = True, args.ocr
    model = settings.model
    model.url, model.key, model.name = args.ocr_api_url or model.url, args.ocr_api_key or model.key, args.ocr_model or model.name
    return recognition.service(settings)


def _converting(args: argparse.Namespace) -> dict:
    return {"formats": args.formats, "recursive": args.recursive, "overwrite": args.overwrite, "layout": args.with_layout, "client": client(args), "pages": args.ocr == "slide"}


def _extracting(args: argparse.Namespace) -> dict:
    return {"threshold": args.threshold, "min_score": args.min_score, "use_simhash": args.simhash, "merge": args.merge, "keep_deprecated": args.keep_deprecated}


def _exporting(args: argparse.Namespace) -> dict:
    return {"target": args.target, "vault": args.vault, "api_url": args.api_url, "api_key": args.api_key or "", "workspace": args.workspace, "db": args.db}


def _lacking(args: argparse.Namespace) -> str | None:
    """What an export target needs and was not given."""
    if args.target == "obsidian" and not args.vault:
        return "--vault is needed"
    if args.target == "notes" and not (args.api_url or args.db):
        return "--api-url or --db is needed"
    return None


def _reports(spark, args: argparse.Namespace) -> None:
    for name, report in pipeline.post_reports(spark, args.db, args.workspace, args.dedup, args.consolidate).items():
        print(f"{name}:")
        report.show(50, truncate=False)


def main(argv: list[str] | None = None) -> int:
    """Runs a command; 0 if it went well."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    if args.command == "webui":
        from sedimenta.webui import serve

        serve(args.port, "0.0.0.0" if args.share else "127.0.0.1")
        return 0
    if not Path(args.source).exists():
        print(f"no such file or folder: {args.source}", file=sys.stderr)
        return 2
    spark = local_session(args.cores)
    source = str(Path(args.source).resolve())
    try:
        if args.command == "convert":
            if args.dry_run:
                rows = pipeline.convert_plan(spark, source, args.formats, args.recursive).groupBy("class").count().collect()
                print({f"to_{r['class']}": r["count"] for r in rows})
            else:
                print(pipeline.convert_tree(spark, source, args.output or f"{source}_mirror", **_converting(args)))
        elif args.command == "extract":
            print(pipeline.extract_tree(spark, source, args.output or f"{source}_extracted", dry_run=args.dry_run, **_extracting(args)))
        elif args.command == "export":
            if _lacking(args):
                raise ValueError(_lacking(args))
            print(pipeline.export_tree(spark, source, output=args.output, **_exporting(args)))
            _reports(spark, args)
        elif args.command == "pipeline":
            wanted = args.target and not _lacking(args)  # a target that lacks something is left out here
            export = _exporting(args) if wanted else None
            print(pipeline.run(spark, source, args.output or f"{source}_knowledge", args.temp_dir, _converting(args), _extracting(args) | {"incremental": args.incremental}, export))
            if wanted:
                _reports(spark, args)
        else:
            print(pipeline.retry_slide(spark, source, recognition.ModelClient(args.ocr_api_url, args.ocr_api_key, args.ocr_model or "")))
    except (ValueError, NotImplementedError, OSError) as failure:
        print(f"error: {failure}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
