"""Command line: ``python -m sievewright {gen-corpus,train,analyze,scan}``. Exit code 2 on what can't be read or understood."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("gen-corpus", help="write the synthetic inert corpus as a table")
    c.add_argument("out")
    c.add_argument("-n", type=int, default=20, help="files of a family")
    c = sub.add_parser("train", help="fit a model to such a table, or to the synthetic corpus")
    c.add_argument("out")
    c.add_argument("--corpus")
    for name, text in (("analyze", "one file, for a reader or as JSON"), ("scan", "a folder, one JSON line a file, counts of verdicts at the end")):
        c = sub.add_parser(name, help=text)
        c.add_argument("path")
        c.add_argument("--model")
        c.add_argument("--json" if name == "analyze" else "--out", **({"action": "store_true"} if name == "analyze" else {}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators import policy, triage
    from .sources import corpus, files

    spark = SparkSession.builder.appName("sievewright").getOrCreate()
    try:
        if args.command == "gen-corpus":
            files.write_corpus(corpus.corpus(spark, args.n), args.out)
            return 0
        if args.command == "train":
            m = triage.trained(spark.read.parquet(args.corpus)) if args.corpus else triage.train_default(spark)
            Path(args.out).write_text(m.to_json() + "\n")
            return 0
        if not Path(args.path).exists():
            raise FileNotFoundError(args.path)
        m = triage.load_model(Path(args.model).read_text()) if args.model else triage.train_default(spark)
        if args.command == "analyze":
            one = spark.read.format("binaryFile").load(args.path).filter(f"length <= {128 << 20}")
            t = triage.triaged(one, m).cache()
            row = t.select("error").first()
            if row is None or row["error"]:
                raise ValueError(row["error"] if row else "the file is too large")
            print(policy.as_json(t, "path").first()["document"] if args.json else files.analysis_text(t).first()["report"])
            return 0
        t = triage.triaged(files.files(spark, args.path), m).cache()
        if args.out:
            files.write_scan(t, args.out)
        else:
            for r in t.orderBy("path").toLocalIterator():
                print(f'{r["path"]}\t{r["verdict"] or "ERROR"}\t{r["score"] if r["score"] is not None else r["error"]}')
        print(", ".join(f"{r['verdict'] or 'ERROR'} {r['count']}" for r in t.groupBy("verdict").count().orderBy("verdict").collect()), file=sys.stderr)
        return 0
    except (FileNotFoundError, ValueError) as e:
        print(f"sievewright: {e}", file=sys.stderr)
        return 2
    finally:
        spark.catalog.clearCache()


if __name__ == "__main__":
    sys.exit(main())
