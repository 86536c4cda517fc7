"""Command line: ``python -m plantgraph.cli <command> ...``; exit codes 0 done, 1 rejected, 2 usage, 3 store."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from . import schema
from .errors import PlantError
from .functions import text
from .operators import diff as diffs
from .operators import queries as q
from .operators import validate
from .sources import canonical, grammar
from .sources.render import render
from .sources.store import Store

OK, REJECTED, USAGE, PERSISTENCE = 0, 1, 2, 3

#: command: (number of arguments, at least), what it prints
COMMANDS = {
    "version": (0, "version and boundary"), "posture": (0, "what is not claimed"), "validate": (1, "FILE: every issue of a draft"), "show": (1, "FILE: the generation as text"),
    "export": (1, "FILE: the generation in the grammar"), "sources": (1, "FILE: structural sources"), "upstream": (2, "FILE NODE"), "downstream": (2, "FILE NODE"), "paths": (3, "FILE FROM TO"),
    "circuits": (3, "FILE FROM TO"), "independent": (3, "FILE FROM TO"), "spof": (2, "FILE NODE..."), "components": (1, "FILE"), "sink": (2, "FILE NODE"), "zone": (2, "FILE NODE"),
    "blast": (2, "FILE NODE"), "group": (2, "FILE GROUP"), "membership": (2, "FILE NODE"), "diff": (2, "BEFORE AFTER"), "store": (1, "FOLDER [head|verify|history|recover]"),
}


def usage() -> str:
    return "usage: plantgraph <command> [arguments]\n" + "\n".join(f"  {name:<12} {what}" for name, (_, what) in COMMANDS.items())


class Unreadable(Exception):
    pass


def _document(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise Unreadable(f"{path}: {e.strerror}") from None


def _built(spark: SparkSession, path: str, generation: int = 1, parent: tuple[int, str] = (0, canonical.NO_DIGEST)):
    return canonical.build(grammar.read(spark, _document(path)), generation, *parent)[0]


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print("  ".join(f"{k}={','.join(map(str, v)) if isinstance(v, list) else v}" for k, v in r.asDict().items()))


def _run(spark: SparkSession, name: str, args: list[str]) -> int:
    if name == "validate":
        report = validate.validate(grammar.read(spark, _document(args[0])))
        _show(report.issues.select("stage", "severity", "code", "subject", "message"))
        print(f"errors {report.error_count()}, warnings {report.warning_count()}")
        return OK if report.valid() else REJECTED
    if name == "diff":
        before = _built(spark, args[0])
        print("\n".join(diffs.explain(diffs.diff(before, _built(spark, args[1], 2, (1, before.digest))))))
        return OK
    if name == "store":
        return _store(spark, args)
    t = _built(spark, args[0])
    rest = args[1:]
    if name == "show":
        print(render(t), end="")
    elif name == "export":
        rows = canonical.order(canonical.rows_of(t))
        print(grammar.write(rows, t.header), end="")
    elif name == "sources":
        _show(t.structural_sources())
    elif name in ("upstream", "downstream"):
        found = (q.upstream_of if name == "upstream" else q.downstream_of)(t, rest[0])
        _show(found.rows.orderBy("depth", "parent", "via_edge").drop("parent"))
        print(f"truncated {found.truncated}, claim {found.claim}")
    elif name == "paths":
        found, pairs, sources = q.possible_supply_paths(t, *rest[:2])
        _show(found.rows.orderBy("path_index"))
        _show(pairs)
        _show(sources)
        print(f"truncated {found.truncated}, claim {found.claim}")
    elif name in ("circuits", "independent"):
        found = (q.possible_circuits if name == "circuits" else q.independent_supply_paths)(t, *rest[:2])
        _show(found.rows.orderBy("path_index"))
        print(f"truncated {found.truncated}, claim {found.claim}")
    elif name == "blast":
        b = q.blast_radius(t, rest[0], include_containment_peers=True)
        for df in (b.affected.rows.orderBy("depth", "parent", "via_edge").drop("parent"), b.sinks, b.zones, b.peers):
            _show(df)
    else:
        run = {"spof": lambda: q.single_points(t, rest).orderBy("node", "subject"), "components": lambda: q.connected_components(t).orderBy("component", "node"), "sink": lambda: q.sink_service_report(t, rest[0]), "zone": lambda: q.zone_report(t, rest[0]), "group": lambda: q.redundancy_group_report(t, rest[0]), "membership": lambda: q.redundancy_membership(t, rest[0])}
        _show(run[name]())
    print(f"claim boundary: {schema.POSTURE}")
    return OK


def _store(spark: SparkSession, args: list[str]) -> int:
    what = args[1] if len(args) > 1 else "head"
    if what == "recover":
        print(Store.recover(spark, args[0]))
        return OK
    if what not in ("head", "verify", "history"):
        print(usage(), file=sys.stderr)
        return USAGE
    with Store.open(spark, args[0], read_only=True) as s:
        if what == "head":
            print("\n".join(f"{k} {v}" for k, v in s.info().items()))
        elif what == "history":
            _show(s.history())
        else:
            found = s.verify()
            _show(found)
            return OK if found.where("severity = 'defect'").isEmpty() else PERSISTENCE
    return OK


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS or len(args) - 1 < COMMANDS[args[0]][0]:
        print(usage(), file=sys.stderr)
        return USAGE
    name, rest = args[0], args[1:]
    if name == "version":
        print(f"plantgraph {schema.VERSION}\n{schema.BOUNDARY}\n{schema.POSTURE}")
        return OK
    if name == "posture":
        print(text.posture_report(), end="")
        return OK
    try:
        return _run(spark or SparkSession.builder.appName("plantgraph").getOrCreate(), name, rest)
    except Unreadable as e:
        print(e, file=sys.stderr)
        return USAGE
    except PlantError as e:
        print(f"error {e}", file=sys.stderr)
        return PERSISTENCE if e.category in ("persistence", "lifecycle") else REJECTED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
