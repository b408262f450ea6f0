"""python -m docloom run PATH --out FOLDER [--gold FILE] [--quiet], or probe PATH [--text] [--labels] [--blocks] [--limit N]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from docloom.operators import evaluate, report
from docloom.plans import extract
from docloom.session import session
from docloom.sources import files


def run(args) -> None:
    """The whole plan over a folder; results are written below --out."""
    spark = session()
    result = extract.run(spark, args.path)
    report.write(result, args.out)
    if args.gold:
        scores = evaluate.score(spark.read.json(args.gold), result.resolved)
        report.evaluation_json(scores).coalesce(1).write.mode("overwrite").text(f"{args.out}/evaluation")
    if not args.quiet:
        result.resolved.where("present").select("package_id", "field", "norm_str", "confidence").orderBy("package_id", "field").show(args.limit, 100)


def probe(args) -> None:
    """What the parsers make of a folder."""
    spark = session()
    blocks, bad = files.parse(files.scan(spark, args.path))
    if args.text:
        for row in blocks.orderBy("doc_id", "block_ord").select("text").limit(args.limit).toLocalIterator():
            print(row["text"])
    if args.labels:
        blocks.where("label IS NOT NULL").select("doc_id", "label", "label_value").show(args.limit, 100)
    if args.blocks or not (args.text or args.labels):
        blocks.orderBy("doc_id", "block_ord").select("doc_id", "block_id", "kind", "section", F.substring("text", 1, 100).alias("text")).show(args.limit, 100)
    bad.show(args.limit, 100)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docloom")
    sub = parser.add_subparsers(required=True)
    r = sub.add_parser("run")
    r.add_argument("path")
    r.add_argument("--out", default="artifacts")
    r.add_argument("--gold", help="gold rows as JSON lines; without it nothing is evaluated")
    r.add_argument("--quiet", action="store_true")
    r.set_defaults(go=run, limit=100)
    p = sub.add_parser("probe")
    p.add_argument("path")
    for flag in ("--text", "--labels", "--blocks"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(go=probe)
    for x in (r, p):
        x.add_argument("--limit", type=int, default=40)
    args = parser.parse_args(argv)
    args.go(args)


if __name__ == "__main__":
    main()
