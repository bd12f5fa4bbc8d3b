"""python -m zastera INPUT OUTPUT: redacts a file, or a folder of DOCX, RTF or text files, into a new folder of OUTPUT.

Exit code 0: all done; 1: files that couldn't be read are left out and named; 2: wrong arguments or no files.
"""

from __future__ import annotations

import argparse
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from zastera.operators import audit, redact
from zastera.sources import files

NOTES = ("Morfologické varianty jmen jsou sloučeny pod jeden label.",)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="zastera", description=__doc__.split("\n")[0])
    p.add_argument("input", help="a file or a folder")
    p.add_argument("output")
    p.add_argument("--format", choices=tuple(files.READERS), default="docx")
    p.add_argument("--batch", action="store_true", help="the input is a folder (told from the input itself anyway)")
    p.add_argument("--names-json", help="library of first names")
    p.add_argument("--run", default=time.strftime("%Y%m%d_%H%M%S"), help="name of the new folder")
    p.add_argument("--types", help="only these types, with commas between them")
    p.add_argument("--extra", default="", help="optional types to look for too, such as AMOUNT,DATE,ORG")
    p.add_argument("--whitelist", action="append", default=[], help="a value to leave alone")
    p.add_argument("--blacklist", action="append", default=[], metavar="TYPE=VALUE", help="a value to redact in any case")
    p.add_argument("--rename", action="append", default=[], metavar="TYPE=LABEL")
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--longest", action="store_true", help="of overlapping finds the longest wins")
    p.add_argument("--surnames", action="store_true", help="surnames that stand alone are persons too")
    p.add_argument("--keep-initials", action="store_true")
    p.add_argument("--show-secrets", action="store_true")
    p.add_argument("--audit", action="store_true", help="print each document's report")
    try:
        args = p.parse_args(argv)
        pairs = lambda items: tuple((t, v) for t, v in (x.split("=", 1) for x in items))
        config = redact.Config(
            types=tuple(args.types.split(",")) if args.types else None, extra=tuple(filter(None, args.extra.split(","))), whitelist=tuple(args.whitelist), blacklist=pairs(args.blacklist), rename=dict(pairs(args.rename)),
            show_secrets=args.show_secrets, min_confidence=args.min_confidence, longest=args.longest, surnames=args.surnames, keep_initials=args.keep_initials,
        )
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError:
        print("TYPE=VALUE is needed", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("zastera").getOrCreate()
    docs = files.READERS[args.format](spark, args.input)
    if docs.isEmpty():
        print("no files", file=sys.stderr)
        return 2
    names = files.first_names(spark, args.names_json) if args.names_json else None
    done = redact.redacted(docs.filter("error IS NULL"), config, names=names).persist(StorageLevel.MEMORY_AND_DISK)
    clear, known = done.select("doc_id", "text"), redact.shown(redact.known(done), config)
    made = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    files.write(clear, redact.map_json(known, made, F.element_at(F.split(F.col("doc_id"), "/"), -1), NOTES), redact.map_lines(known), args.output, args.run)
    if args.format == "docx":
        files.write_docx(spark, args.input, clear, f"{args.output}/{args.run}/docx")
    counts = {r["type"]: r["count"] for r in known.groupBy("type").count().collect()}
    person = config.rename.get("PERSON", "PERSON")
    print(f"persons: {counts.get(person, 0)}, entities: {sum(counts.values())}, folder: {args.output}/{args.run}")
    for r in done.select("doc_id", F.explode("warnings").alias("w")).select("doc_id", "w.*").toLocalIterator():
        print(f"{r['doc_id']}: not sure enough ({r['confidence']}): {r['type']}", file=sys.stderr)
    if args.audit:
        found = audit.findings(clear, redact.known(done))
        for r in audit.report(audit.score(clear, found), found).toLocalIterator():
            print(f"{r['doc_id']}\n{r['report']}")
    broken = 0
    for r in docs.filter("error IS NOT NULL").select("doc_id", "error").toLocalIterator():
        broken += 1
        print(f"{r['doc_id']}: {r['error']}", file=sys.stderr)
    return 1 if broken else 0


if __name__ == "__main__":
    sys.exit(main())
