"""``python -m kinweave COMMAND FOLDER``: look into a saved genealogy or write it in an exchange format to standard output."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from kinweave.model import SCHEMAS, Genealogy


def info(g: Genealogy) -> Iterator[str]:
    from kinweave.plans.ancestry import trees

    yield f"sequence_length\t{g.sequence_length:g}"
    yield f"time_units\t{g.time_units}"
    yield f"trees\t{trees(g).count()}"
    yield f"samples\t{g.samples().count()}"
    for t in SCHEMAS:
        yield f"{t}\t{getattr(g, t).count()}"


def rows(g: Genealogy, table: str, precision: int) -> Iterator[str]:
    from kinweave.sources.store import text_header, text_rows

    yield text_header(table)
    for r in text_rows(g, table, precision).orderBy("id").toLocalIterator():
        yield r["line"]


def newick(g: Genealogy, precision: int) -> Iterator[str]:
    from kinweave.operators import localtrees as lt
    from kinweave.plans.ancestry import trees

    for r in lt.newick(g, precision).join(trees(g), "tree").orderBy("tree", "root").toLocalIterator():
        yield f"{r['tree']}\t{r['left']:g}\t{r['right']:g}\t{r['newick']}"


def vcf(g: Genealogy, ploidy: int | None, contig: str, zero: bool) -> Iterator[str]:
    from kinweave.sources.formats import vcf_lines

    head, body = vcf_lines(g, ploidy, contig, allow_position_zero=zero)
    yield from head
    for r in body.orderBy("position", "site").toLocalIterator():
        yield r["line"]


def fasta(g: Genealogy, reference: str, width: int) -> Iterator[str]:
    from kinweave.sources import formats

    with open(reference) as f:
        text = "".join(x.strip() for x in f if not x.startswith(">"))
    for r in formats.fasta(g, text, width).orderBy("sample").toLocalIterator():
        yield r["record"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "trees", "vcf", "fasta", *SCHEMAS):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("-p", "--precision", type=int, default=6)
        if name == "vcf":
            s.add_argument("-P", "--ploidy", type=int)
            s.add_argument("-c", "--contig-id", default="1")
            s.add_argument("-0", "--allow-position-zero", action="store_true")
        if name == "fasta":
            s.add_argument("reference")
            s.add_argument("-w", "--wrap", type=int, default=60)
    return p


def lines(g: Genealogy, a: argparse.Namespace) -> Iterator[str]:
    if a.command == "info":
        return info(g)
    if a.command == "trees":
        return newick(g, a.precision)
    if a.command == "vcf":
        return vcf(g, a.ploidy, a.contig_id, a.allow_position_zero)
    if a.command == "fasta":
        return fasta(g, a.reference, a.wrap)
    return rows(g, a.command, a.precision)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from kinweave.sources.store import load

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    try:
        for x in lines(load(spark, a.folder), a):
            print(x)
    except BrokenPipeError:
        sys.stderr.close()


if __name__ == "__main__":
    main()
