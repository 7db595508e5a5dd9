"""A command line over a stored graph: python -m lattica.cli [--store DIR | --live DIR] [-c TEXT | -f FILE] [--mode table|csv|json|line]."""

from __future__ import annotations

import argparse
import csv
import sys
import time
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .errors import GraphError
from .graph import PropertyGraph
from .plans.lexer import tokenise
from .session import GraphSession
from .sources.export import export_cypher, json_rows
from .sources.store import load_graph, save_graph

HELP = ".help .quit .exit .timer on|off .mode table|csv|json|line .tables .stats .export .save DIR"


def shown(df: DataFrame, mode: str, out: TextIO | None = None) -> int:
    """Prints the rows as they come, and counts them."""
    n, out = 0, out or sys.stdout
    if not df.columns:
        return n
    if mode == "table":
        df.show(1000, truncate=False)
        return -1
    if mode == "json":
        for r in json_rows(df).toLocalIterator():
            print(r[0], file=out)
            n += 1
        return n
    writer = csv.writer(out)
    if mode == "csv":
        writer.writerow(df.columns)
    for r in df.toLocalIterator():
        n += 1
        if mode == "csv":
            writer.writerow(["" if v is None else v for v in r])
        else:
            print("\n".join(f"{c} = {v}" for c, v in zip(df.columns, r, strict=True)) + "\n", file=out)
    return n


class Shell:
    def __init__(self, session: GraphSession, mode: str = "table", timer: bool = True) -> None:
        self.session, self.mode, self.timer = session, mode, timer

    def command(self, line: str) -> bool:
        """A dot command; false ends the session."""
        word, _, rest = line.partition(" ")
        if word in (".quit", ".exit"):
            return False
        if word == ".timer":
            self.timer = rest.strip() != "off"
        elif word == ".mode" and rest.strip() in ("table", "csv", "json", "line"):
            self.mode = rest.strip()
        elif word == ".tables":
            print("\n".join([*(":".join(k) or "-" for k in self.session.graph.nodes), *(f"[:{t}]" for t in self.session.graph.edges)]))
        elif word == ".stats":
            print(f"{self.session.graph.node_count()} nodes, {self.session.graph.edge_count()} relationships")
        elif word == ".export":
            print(export_cypher(self.session.graph))
        elif word == ".save" and rest.strip():
            save_graph(self.session.graph, rest.strip(), "overwrite")
        else:
            print(HELP)
        return True

    def run(self, text: str) -> bool:
        began = time.perf_counter()
        try:
            shown(self.session.cypher(text), self.mode)
        except GraphError as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return False
        if self.timer:
            print(f"{time.perf_counter() - began:.3f} s")
        return True


def statements(text: str) -> list[str]:
    """The statements of a text, which semicolons end."""
    ends = [t.at for t in tokenise(text) if t.kind == "end" or (t.kind, t.text) == ("op", ";")]
    parts = [text[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
    return [p for p in parts if p.strip()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--store", help="a saved graph to read")
    parser.add_argument("--live", help="a store that every statement is committed to")
    parser.add_argument("-c", "--command")
    parser.add_argument("-f", "--file")
    parser.add_argument("--mode", choices=["table", "csv", "json", "line"], default="table")
    parser.add_argument("--no-timer", action="store_true")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    session = GraphSession.stored(spark, options.live) if options.live else GraphSession(load_graph(spark, options.store) if options.store else PropertyGraph(spark))
    shell = Shell(session, options.mode, not options.no_timer)
    if options.command or options.file:
        text = options.command or open(options.file, encoding="utf-8").read()
        return int(not all([shell.run(t) for t in statements(text)]))
    for line in sys.stdin:
        line = line.strip()
        if line.startswith("."):
            if not shell.command(line):
                break
        elif line:
            shell.run(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
