"""A small shell: python -m loomwork.cli [-c SQL | -f FILE] [--master ADDRESS] [--format table|csv|json] [--maxrows N]."""

from __future__ import annotations

import argparse
import csv
import sys
import time

from pyspark.sql import DataFrame

from loomwork import dialect
from loomwork.session import Loom, remote, standalone

HELP = r"""\q quit   \d list tables   \d NAME columns of a table   \h list functions   \h NAME describe one
\quiet on|off   timings   \pset format table|csv|json   \pset maxrows N|unlimited   \? this help"""


class Shell:
    def __init__(self, loom: Loom, kind: str = "table", out=sys.stdout, most: int | None = None):
        self.loom, self.kind, self.quiet, self.out, self.most = loom, kind, False, out, most

    def show(self, df: DataFrame) -> None:
        """Writes every row, or the first self.most; csv and json a row at a time."""
        rows = df if self.most is None else df.limit(self.most)
        if self.kind == "csv":
            to = csv.writer(self.out, lineterminator="\n")
            to.writerow(rows.columns)
            to.writerows(rows.toLocalIterator())
        elif self.kind == "json":
            self.out.writelines(x + "\n" for x in rows.toJSON().toLocalIterator())
        else:
            self.out.write(rows._show_string((1 << 31) - 2 if self.most is None else self.most, False, False))

    def command(self, line: str) -> bool:
        """A backslash command; False ends the shell."""
        name, _, rest = line.strip().partition(" ")
        spark, rest = self.loom.spark, rest.strip()
        if name == r"\q":
            return False
        if name == r"\d":
            self.show(spark.sql(f"DESCRIBE {rest}") if rest else self.loom.tables())
        elif name == r"\h":
            self.show(spark.sql(f"DESCRIBE FUNCTION EXTENDED {rest}") if rest else spark.sql("SHOW FUNCTIONS"))
        elif name == r"\quiet":
            self.quiet = rest != "off" if rest else not self.quiet
        elif name == r"\pset":
            if rest.startswith("maxrows"):
                self.most = None if rest.split()[-1] == "unlimited" else int(rest.split()[-1])
            else:
                self.kind = rest.split()[-1] if rest else self.kind
        else:
            self.out.write(HELP + "\n")
        return True

    def run(self, text: str) -> None:
        for statement in dialect.statements(text):
            start = time.time()
            self.show(self.loom.sql(statement))
            if not self.quiet:
                self.out.write(f"({time.time() - start:.2f} s)\n")

    def loop(self) -> None:
        held = ""
        while True:
            try:
                line = input("loom> " if not held else "  ... ")
            except EOFError:
                return
            if not held and line.startswith("\\"):
                if not self.command(line):
                    return
                continue
            held += line + "\n"
            if line.rstrip().endswith(";"):
                try:
                    self.run(held)
                except Exception as e:  # noqa: BLE001  a shell goes on
                    print(e, file=sys.stderr)
                held = ""


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomwork", description=__doc__)
    p.add_argument("-c", "--command", action="append", default=[])
    p.add_argument("-f", "--file", action="append", default=[])
    p.add_argument("--master")
    p.add_argument("--format", default="table", choices=("table", "csv", "json"))
    p.add_argument("--maxrows", type=int, help="rows to write of each result; all by default")
    p.add_argument("-q", "--quiet", action="store_true")
    own = p.parse_args(args)
    shell = Shell(remote(own.master) if own.master else standalone(), own.format, most=own.maxrows)
    shell.quiet = own.quiet
    for name in own.file:
        with open(name, encoding="utf8") as f:
            shell.run(f.read())
    for text in own.command:
        shell.run(text)
    if not own.file and not own.command:
        shell.loop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
