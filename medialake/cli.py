"""Command line: index, sync, stats, search, export."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from medialake.plans.library import Library
from medialake.plans.pipelines import index, sync
from medialake.sources.json_store import export
from medialake.sources.objects import list_as_files
from medialake.sources.walk import list_files

VERSION = "0.1.0"


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    return SparkSession.builder.appName("medialake").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="medialake", description="Index and query image libraries with Spark.")
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    commands = p.add_subparsers(dest="command")
    # Names and defaults of the commands and options.
    one = commands.add_parser("index", help="scan a folder and save all images")
    one.add_argument("--path", required=True)
    one.add_argument("--workers", type=int, default=4)
    two = commands.add_parser("sync", help="apply what changed on disk")
    two.add_argument("--path", required=True)
    two.add_argument("--cleanup-deleted", action="store_true")
    two.add_argument("--no-reprocess", dest="reprocess_modified", action="store_false")
    two.add_argument("--no-index", dest="index_new", action="store_false")
    two.add_argument("--dry-run", action="store_true")
    three = commands.add_parser("stats", help="count the images")
    four = commands.add_parser("search", help="find images")
    for name in ("date-from", "date-to", "camera", "tags"):
        four.add_argument(f"--{name}")
    four.add_argument("--location", help="lat,lon,radius_km")
    five = commands.add_parser("export", help="write all images as a JSON document store")
    five.add_argument("--out", required=True)
    five.add_argument("--single", action="store_true", help="one file")
    for c in (one, two, three, four, five):
        c.add_argument("--db", default="media_library")
    return p


def source_of(path: str):
    """How to list ``path``: a folder of a disk, or an object store by its URI."""
    return list_as_files if "://" in path else list_files


def progress(counts: dict) -> None:
    logging.getLogger("medialake").info("%s files, %s errors, %.0f images a minute", counts["discovered"], counts["errors"], counts["images_per_minute"])


def run(args: argparse.Namespace) -> int:
    spark = session()
    library = Library(spark, args.db)
    if args.command == "index":
        r = index(spark, args.path, library, workers=args.workers, source=source_of(args.path), progress=progress, every=10.0)
        print(f"Indexed {r.processed} of {r.discovered} files ({r.errors} errors).")
    elif args.command == "sync":
        r = sync(spark, args.path, library, args.cleanup_deleted, args.reprocess_modified, args.index_new, args.dry_run, source=source_of(args.path))
        print(f"new={r.new_files} modified={r.modified_files} deleted={r.deleted_entries} unchanged={r.unchanged_files} errors={r.error_count}")
        return 2 if r.error_count else 0
    elif args.command == "stats":
        print(f"{library.count()} images")
    elif args.command == "export":
        export(library.read(), args.out, single=args.single)
        print(f"{library.count()} images written to {args.out}")
    elif args.command == "search":
        place = tuple(float(x) for x in args.location.split(",")) if args.location else None
        found = library.search(args.date_from, args.date_to, args.camera, place, args.tags.split(",") if args.tags else None)
        for row in found.select("file_info.path").toLocalIterator():
            print(row.path)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    logging.getLogger("medialake").setLevel(args.log_level)
    if not args.command:
        p.print_help()
        return 0
    try:
        return run(args)
    except Exception as e:  # noqa: BLE001
        logging.getLogger("medialake").debug("failed", exc_info=True)
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
