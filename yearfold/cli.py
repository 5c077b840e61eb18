"""Command line: partitions the configured tables of a registry, or takes that back."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from yearfold.functions.scalars import checked_name
from yearfold.plans import rebuild, related
from yearfold.sources import storage
from yearfold.sources.registry import Registry

COLOURS = {"SUCCESS": "\033[32m", "SKIPPED": "\033[33m", "FAILURE": "\033[31m"}


def report(outcomes: list[storage.Outcome], details: list[related.Detail] = (), plain: bool = True) -> str:
    """The outcomes of a run in words, the totals last; in colours unless plain."""
    paint = (lambda s: s) if plain else (lambda s: f"{COLOURS.get(s, '')}{s}\033[0m")
    out = [f"{paint(o.status)} {o.table}: {o.n_rows} rows, {o.seconds:.1f} s" + (f" ({o.message})" if o.message else "") for o in outcomes]
    out += [f"  {paint(d.status)} {d.table_name}.{d.constraint_name}: {d.n_updated} helpers set" + (f" ({d.message})" if d.message else "") for d in details]
    count = lambda s: sum(o.status == s for o in outcomes)
    out.append(f"{count('SUCCESS')} done, {count('SKIPPED')} skipped, {count('FAILURE')} failed; {sum(d.n_updated for d in details if d.status == 'SUCCESS')} helpers set")
    return "\n".join(out)


def configured(registry: Registry, names: str | None) -> list[tuple[str, str]]:
    """(table, field) of the settings, or of those named; of several fields the first in order. Unknown names raise."""
    fields: dict[str, str] = {}
    for r in sorted(registry.get("config").collect(), key=lambda r: (r.table_name.lower(), r.field)):
        fields.setdefault(r.table_name.lower(), r.field)
    wanted = [checked_name(n.strip()).strip("`").lower() for n in names.split(",")] if names else sorted(fields)
    for n in wanted:
        if n not in fields:
            raise storage.PartitionError(f"{n} is not configured")
    return [(n, fields[n]) for n in wanted]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask=input, say=print) -> int:
    """0 unless a table failed or nothing was confirmed."""
    p = argparse.ArgumentParser(prog="yearfold", description=__doc__)
    p.add_argument("action", choices=["partition", "unpartition"])
    p.add_argument("--registry", required=True, help="the folder of the registry")
    p.add_argument("--tables", help="names, joined by commas; all configured ones by default")
    p.add_argument("--dry-run", action="store_true", help="say what would be done")
    p.add_argument("--plain-output", action="store_true", help="no colours")
    p.add_argument("--yes", action="store_true", help="do not ask")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("yearfold").getOrCreate()
    registry = Registry(spark, a.registry)
    registry.ensure()
    tables = configured(registry, a.tables)
    if a.dry_run and a.action == "partition":
        for t, f in tables:
            for r in rebuild.partition_plan(spark, t, f, [c.table for c in related.children_of(registry, t)]).orderBy("step").collect():
                say(f"{r.step}. {r.action} {r.target}")
    elif a.dry_run:
        for t, _ in tables:
            say(f"unpartition {t}")
        return 0
    elif not a.yes and ask(f"{a.action} {', '.join(t for t, _ in tables) or 'nothing'}? Type yes: ").strip().lower() != "yes":
        say("nothing was done")
        return 1
    details: list[related.Detail] = []

    def one(table: str, field: str) -> storage.Outcome:
        if a.action == "unpartition":
            return related.unpartition(registry, table)
        outcome, more = related.partition(registry, table, field, a.dry_run)
        details.extend(more)
        return outcome

    outcomes = storage.run_all(tables, one)
    say(report(outcomes, details, a.plain_output or not sys.stdout.isatty()))
    return int(any(o.status == "FAILURE" for o in outcomes))


if __name__ == "__main__":
    sys.exit(main())
