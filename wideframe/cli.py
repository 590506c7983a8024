"""Command line over an instance: ``python -m wideframe.cli INSTANCE COMMAND ...``.

A write rewrites its table, so bulk writes are made with ``operators.mutations``.
Keys are written as ``functions.keys.parse_key`` reads them; cells hold strings.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wideframe.functions import keys, synth
from wideframe.operators import mutations, paging, results
from wideframe.plans import compiler
from wideframe.plans.layout import Layout
from wideframe.plans.request import DataRequest, parse_column
from wideframe.sources.catalog import Instance

#: Further commands: name -> (adds arguments to a parser, runs on (spark, instance, arguments) and returns lines).
COMMANDS: dict[str, tuple[Callable[[argparse.ArgumentParser], None], Callable[[SparkSession, Instance, argparse.Namespace], list[str]]]] = {}

CELLS = "key binary, family string, qualifier string, version bigint, value string"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="wideframe", description=__doc__)
    parser.add_argument("instance", help="address of the instance's folder")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("install", "uninstall", "ls", "system-table", "schema-table", "version"):
        commands.add_parser(name)
    create = commands.add_parser("create-table")
    create.add_argument("layout", help="file with the layout's JSON")
    commands.add_parser("delete-table").add_argument("table")
    own = commands.add_parser("layout")
    own.add_argument("table")
    own.add_argument("--history", action="store_true", help="all layouts, oldest first")
    own.add_argument("--set", dest="wanted", help="file with the JSON of the next layout")
    own.add_argument("--delete", nargs="*", default=[], help="what the next layout leaves out")
    own.add_argument("--dry-run", action="store_true")
    for name, (configure, _) in COMMANDS.items():
        configure(commands.add_parser(name))
    for name in ("get", "scan", "put", "increment", "delete"):
        own = commands.add_parser(name)
        own.add_argument("table")
        own.add_argument("--columns", nargs="*", default=[])
        own.add_argument("--max-versions", type=int, default=1)
        own.add_argument("--timestamp", type=int, default=None)
        own.add_argument("--key")
        own.add_argument("--start")
        own.add_argument("--stop")
        own.add_argument("--max-rows", type=int, default=0)
        own.add_argument("--value")
    notes = commands.add_parser("notes")
    notes.add_argument("table")
    notes.add_argument("--column", default="")
    notes.add_argument("--set", nargs=2, metavar=("KEY", "NOTE"))
    metadata = commands.add_parser("metadata")
    metadata.add_argument("action", choices=("backup", "restore"))
    metadata.add_argument("path")
    users = commands.add_parser("synthesize-user-data")
    users.add_argument("table")
    users.add_argument("--num-users", type=int, default=100)
    return parser


def _columns(layout: Layout, names: list[str]) -> list[str]:
    return names or sorted(layout.families)


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Runs a command and returns its lines."""
    args = _parser().parse_args(argv)
    home, command = Instance(spark, args.instance), args.command
    if command == "install":
        home.install()
        return [f"installed {home.path}"]
    if command == "uninstall":
        home.uninstall()
        return [f"removed {home.path}"]
    if command in COMMANDS:
        return COMMANDS[command][1](spark, home, args)
    if command == "ls":
        return home.tables()
    if command == "version":
        return [f"data version {home.system()['data-version']}"]
    if command == "system-table":
        return [f"{k} = {v}" for k, v in sorted(home.system().items())]
    if command == "schema-table":
        return [f"{r['schema_id']}: {r['schema']}" for r in home.schema_table().orderBy("schema_id").toLocalIterator()]
    if command == "create-table":
        with open(args.layout, encoding="utf-8") as f:
            layout = Layout.from_json(f.read())
        home.create(layout, spark.createDataFrame([], CELLS))
        return [f"created {layout.name}"]
    if command == "metadata":
        (home.export_metadata if args.action == "backup" else home.restore_metadata)(args.path)
        return [f"{args.action} of {home.path} done"]
    layout = home.layout(args.table)
    if command == "delete-table":
        home.drop(args.table)
        return [f"deleted {args.table}"]
    if command == "layout" and args.history:
        return [f"{x.layout_id} after {x.reference_id}" for x in home.layouts(args.table)]
    if command == "layout" and args.wanted:
        with open(args.wanted, encoding="utf-8") as f:
            made = home.modify(Layout.from_json(f.read()), tuple(args.delete), dry_run=args.dry_run)
        return [f"layout {made.layout_id}" + (" (dry run)" if args.dry_run else "")]
    if command == "layout":
        return json.dumps(json.loads(layout.to_json()), indent=2).split("\n")
    if command == "notes":
        if args.set:
            home.annotate(args.table, *args.set, column=args.column)
        return [f"{column or args.table} {key}: {note}" for (column, key), note in sorted(home.notes(args.table, args.column or None).items())]
    cells, now = home.cells(args.table), int(time.time() * 1000)
    if command == "synthesize-user-data":
        made = synth.users(spark, args.num_users, ["Ada", "Bo", "Cy", "Di", "Ed"], ["mail.example.com", "post.example.org"], version=now)
        made = made.withColumn("key", keys.encode_key(layout.key, *[F.col("key").cast("string" if kind == "STRING" else "bigint") for _, kind in layout.key.components]))
        home.save(args.table, mutations.put(cells, made))
        return [f"{args.num_users} users"]
    key = lambda text: None if text is None else keys.parse_key(text, layout.key)
    if command in ("get", "scan"):
        request = DataRequest.of(*_columns(layout, args.columns), max_versions=args.max_versions)
        if command == "get":
            found = compiler.get(cells, key(args.key), request, layout)
        else:
            found = compiler.scan(paging.row_limit(compiler.key_range(cells, key(args.start), key(args.stop)), args.max_rows), request, layout)
        return [f"{bytes(r['key']).hex()} {r['family']}:{r['qualifier']} {r['version']} {r['value']}" for r in results.ordered(found).toLocalIterator()]
    family, qualifier = parse_column(args.columns[0]) if args.columns else (None, None)
    target = [(key(args.key), family, qualifier)]
    if command == "put":
        home.save(args.table, mutations.put(cells, spark.createDataFrame([(*target[0], args.timestamp if args.timestamp is not None else now, args.value)], CELLS)))
    elif command == "increment":
        deltas = spark.createDataFrame([(*target[0], int(args.value or 1))], "key binary, family string, qualifier string, delta bigint")
        home.save(args.table, mutations.increment(cells, deltas, now, layout, args.columns[:1]))
    else:
        level = "row" if family is None else "family" if qualifier is None else "column"
        gone = spark.createDataFrame(target, "key binary, family string, qualifier string")
        home.save(args.table, mutations.delete(cells, gone, level, args.timestamp))
    return [f"{command} done"]


def main(argv: list[str] | None = None) -> None:
    import sys

    spark = SparkSession.builder.appName("wideframe").getOrCreate()
    for line in run(spark, sys.argv[1:] if argv is None else argv):
        print(line)


if __name__ == "__main__":
    main()
