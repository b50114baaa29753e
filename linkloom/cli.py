"""Command line: export, check, repair, merge, upgrade, cleanup, ingest, frontier, resume, options."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from types import ModuleType

from pyspark.sql import SparkSession, functions as F

from . import presets, sinks
from .functions.text import ESCAPES
from .functions.urls import site
from .model import Store
from .operators import storage
from .operators.frontier import STATE_PRIORITY
from .plans import exports
from .plans.filters import ALIASES, PREDICATES
from .plans.wide import ATTRIBUTES


def compose(*configs: dict) -> dict:
    """Deep merge: mappings recurse, sets unite, lists append, all else is overridden."""
    out: dict = {}
    for config in configs:
        for k, v in config.items():
            old = out.get(k)
            if isinstance(old, dict) and isinstance(v, dict):
                out[k] = compose(old, v)
            elif isinstance(old, set) and isinstance(v, set):
                out[k] = old | v
            elif isinstance(old, list) and isinstance(v, list):
                out[k] = old + v
            else:
                out[k] = v
    return out


_DOMAINS = """filters: +f domain under NAME keeps what is at the domain or below it (several are alternatives), -f domain under NAME drops it."""
HELP = {
    "urls": f"""filters: +f ATTRIBUTE PREDICATE VALUE keeps, -f ... drops; all are to hold.
attributes: {", ".join(ATTRIBUTES)}
predicates: {", ".join(PREDICATES)}, or {", ".join(f"{a} for {b}" for a, b in ALIASES.items())}; "is None", "is True" and "is False" test the state.
  startswith, endswith and contains are blind to the case of A-Z, and % and _ in the value stand for any text and any character.
options: fmt=TEMPLATE names the file of a row, with %(ATTRIBUTE)s fields as in "%(feed:netloc)s/%(published:year)d.txt";
  format=lines|csv; key=ATTRIBUTE, or a comma list for csv; escape={"|".join(str(e) for e in ESCAPES if e)}; parts=N files for each name.""",
    "graph": f"{_DOMAINS}\noptions: graphtype=hyperlink|domain. Edges have the type and time of the last link, or a count for each tag.",
    "uncharted": f"{_DOMAINS}\nThe report has page_count, keywords and referrers of domains without a feed.",
}


#: A package without __init__.py, whose modules, anywhere on the path, are exporters of their own.
EXPORTERS = "linkloom_exporters"


def exporter(topic: str) -> ModuleType | None:
    """A user's exporter: a module with ``export(tables, output, include, exclude, **options)``, and HELP if it has a help text."""
    name = f"{EXPORTERS}.{topic}"
    try:
        found = importlib.import_module(name)
    except ModuleNotFoundError as e:
        if e.name not in (EXPORTERS, name):
            raise
        return None
    return found if callable(getattr(found, "export", None)) else None


def plan_frontier(spark: SparkSession, output: str, options: dict) -> None:
    """Writes the sites that a frontier reaches to output/sites; what is done is kept in output/state."""
    from .plans.sites import planned_sites

    if options["presets"]:
        presets.register(options["presets"])
    preset = presets.chosen(options["preset"], options["feeds"][0])
    given = {"depth": options["depth"], "feed_state": options["feed_state"], "follow": tuple(options["follow"]) or None}
    preset = presets.Preset(**compose({f.name: getattr(preset, f.name) for f in dataclasses.fields(preset)}, {k: v for k, v in given.items() if v is not None}))
    seeds = spark.createDataFrame([(f,) for f in options["feeds"]], "url string").select(site("url").alias("site"))
    sites = planned_sites(Store(spark, options["input"]).open(), seeds, preset, options["threshold"], f"{output}/state")
    sites.write.mode("overwrite").parquet(f"{output}/sites")
    n = spark.read.parquet(f"{output}/sites").agg(F.count(F.lit(1)).alias("sites"), F.max("depth").alias("depth")).first()
    print(json.dumps(n.asDict()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    sub = p.add_subparsers(dest="command", required=True)
    export = sub.add_parser("export", help="urls, graph or uncharted, with key=value options of the topic", prefix_chars="-+")
    export.add_argument("topic", help=f"urls, graph, uncharted, or a module of {EXPORTERS}")
    export.add_argument("-i", "--input", required=True)
    export.add_argument("-o", "--output", required=True)
    export.add_argument("+f", "--include", nargs=3, action="append", default=[])
    export.add_argument("-f", "--exclude", nargs=3, action="append", default=[])
    for name in ("check", "repair", "upgrade", "cleanup"):
        sub.add_parser(name).add_argument("input")
    sub.choices["repair"].add_argument("--unlock", action="store_true", help="also if it is locked: no writer may be at work")
    merge = sub.add_parser("merge", help="several stores into a new one")
    merge.add_argument("inputs", nargs="+")
    merge.add_argument("-o", "--output", required=True)
    ingest = sub.add_parser("ingest", help="JSON pages into a store")
    ingest.add_argument("pages")
    ingest.add_argument("store")
    ingest.add_argument("checkpoint")
    ingest.add_argument("--paged", action="store_true", help="pages are folders of chains, in which each page names the next one")
    plan = sub.add_parser("frontier", help="the sites that a store's links lead to from feeds, with where their feeds may be")
    plan.add_argument("input")
    plan.add_argument("feeds", nargs="+", help="URLs of feeds; the first one chooses the preset")
    plan.add_argument("-o", "--output", required=True)
    plan.add_argument("--preset", help="its name, or a .json or .py file; default: that of the feed's site")
    plan.add_argument("--presets", help="a folder of presets of one's own")
    plan.add_argument("--threshold", type=int, default=0, help="sites that are mentioned more often are scheduled")
    plan.add_argument("--depth", type=int, help="0: no limit")
    plan.add_argument("--feed-state", choices=tuple(STATE_PRIORITY))
    plan.add_argument("--follow", action="append", default=[], help="a domain; may be given several times")
    sub.add_parser("resume", help="goes on with a frontier that was interrupted").add_argument("output")
    options = sub.add_parser("options", help="attributes of the filter grammar; with a topic, its filters and options")
    options.add_argument("topic", nargs="?")
    return p


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args, extra = parser().parse_known_args(argv)
    if any("=" not in e or args.command != "export" for e in extra):
        parser().error(f"unrecognized arguments: {' '.join(extra)}")
    own = None
    if args.command in ("export", "options") and args.topic and args.topic not in HELP:
        own = exporter(args.topic)
        if not own:
            print(f"no exporter for the topic {args.topic}; there are {', '.join(HELP)} and modules of {EXPORTERS}", file=sys.stderr)
            return 1
    if args.command == "options":
        print((getattr(own, "HELP", own.__doc__) or "" if own else HELP[args.topic]) if args.topic else "\n".join(ATTRIBUTES))
        return 0
    spark = spark or SparkSession.builder.appName("linkloom").getOrCreate()
    if args.command == "export":
        tables = Store(spark, args.input).open()
        extras = dict(e.split("=", 1) for e in extra)
        include, exclude = [tuple(f) for f in args.include], [tuple(f) for f in args.exclude]
        if own:
            own.export(tables, args.output, include, exclude, **extras)
        elif args.topic == "urls":
            parts = int(extras.pop("parts", 1))
            written = sinks.write_by_path(exports.urls(tables, include, exclude, **extras), args.output, extras.get("format", "lines"), parts=parts)
            n = written.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
            print(json.dumps(n.asDict()))
        elif args.topic == "graph":
            graph = exports.domain_graph if extras.get("graphtype", "hyperlink") == "domain" else exports.hyperlink_graph
            sinks.write_graphml(*graph(tables, include=include, exclude=exclude), args.output)
        else:
            sinks.write_uncharted(exports.uncharted(tables, include, exclude), args.output)
    elif args.command in ("check", "repair"):
        store = Store(spark, args.input)
        if args.command == "repair" and store.locked:
            if not args.unlock:
                print(f"{store.path} is locked; if no writer is at work, repair it with --unlock", file=sys.stderr)
                return 1
            store.unlock()
        base, tables = store.generation, store.open()
        bad = storage.orphans(tables).count(), storage.duplicates(tables).where("n_keys > 0").count()
        print(json.dumps({"orphans": bad[0], "tables_with_duplicates": bad[1]}))
        if args.command == "check":
            return int(any(bad))
        store.save(storage.repair(tables), base)
    elif args.command == "merge":
        Store(spark, args.output).save(storage.merge_all([Store(spark, i).open() for i in args.inputs]))
    elif args.command == "upgrade":
        print(json.dumps(storage.upgrade(Store(spark, args.input))))
    elif args.command == "cleanup":
        from .streaming.ingest import merge_staged

        print(json.dumps({"merged": merge_staged(Store(spark, args.input))}))
    elif args.command == "ingest":
        from .sources.paged import paged_stream
        from .streaming.ingest import ingest

        source = paged_stream(spark, args.pages, f"{args.checkpoint}-marks/reached") if args.paged else args.pages
        ingest(spark, source, Store(spark, args.store), args.checkpoint).awaitTermination()
    elif args.command == "frontier":
        fs, root = sinks._file_system(args.output)
        if fs.get_file_info(f"{root}/options.json").is_file:
            print(f"{args.output} holds a frontier already; go on with it by resume", file=sys.stderr)
            return 1
        kept = {k: v for k, v in vars(args).items() if k not in ("command", "output")}
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/options.json") as f:
            f.write(json.dumps(kept).encode())
        plan_frontier(spark, args.output, kept)
    elif args.command == "resume":
        fs, root = sinks._file_system(args.output)
        try:
            with fs.open_input_stream(f"{root}/options.json") as f:
                kept = json.loads(f.read())
        except (FileNotFoundError, ValueError):
            print(f"{args.output} has no options.json of a frontier", file=sys.stderr)
            return 1
        plan_frontier(spark, args.output, kept)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
