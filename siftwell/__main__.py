"""Command line: python -m siftwell add|delete|stats|query ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from siftwell.sources.store import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("--path", help="the collection's folder (default: INDEX_DIR)")
    p.add_argument("--limit", type=int, help="rows that are printed (default: all)")
    top = p.add_subparsers(dest="command", required=True)
    add = top.add_parser("add", help="commit the documents of a JSON file")
    add.add_argument("file")
    add.add_argument("max_depth", nargs="?", type=int)
    top.add_parser("delete").add_argument("id")
    top.add_parser("stats")
    q = top.add_parser("query").add_subparsers(dest="query", required=True)
    q.add_parser("lang").add_argument("text")
    q.add_parser("get").add_argument("id")
    for name in ("words", "and", "not"):
        q.add_parser(name).add_argument("words", nargs="+")
    fuzzy = q.add_parser("ngram-bm25")
    fuzzy.add_argument("text")
    for name, kind, default in (("k1", float, 1.2), ("b", float, 0.75), ("alpha", float, 0.6), ("beta", float, 0.4), ("top_k", int, 10)):
        fuzzy.add_argument(name, nargs="?", type=kind, default=default)
    for name in ("range", "between"):
        s = q.add_parser(name)
        s.add_argument("field")
        s.add_argument("min", type=int)
        s.add_argument("max", type=int)
    for name in ("gt", "gte", "lt", "lte"):
        s = q.add_parser(name)
        s.add_argument("field")
        s.add_argument("value", type=int)
    return p


def answer(engine: Engine, a: argparse.Namespace) -> DataFrame:
    if a.query == "get":
        return engine.get(a.id)
    c = engine.collection()
    if a.query == "lang":
        return c.query(a.text)
    if a.query in ("words", "and", "not"):
        return {"words": c.words, "and": c.and_words, "not": c.not_words}[a.query](a.words)
    if a.query == "ngram-bm25":
        return c.ngram_bm25(a.text, a.k1, a.b, a.alpha, a.beta, a.top_k)
    if a.query in ("range", "between"):
        return getattr(c, a.query)(a.field, a.min, a.max).select("doc_id", "path")
    return getattr(c, a.query)(a.field, a.value).select("doc_id", "path")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("siftwell").getOrCreate()
    engine = Engine(spark, a.path)
    if a.command == "add":
        print("\n".join(engine.add_file(a.file, a.max_depth)))
    elif a.command == "delete":
        engine.delete(a.id)
    elif a.command == "stats":
        print(engine.stats().first().asDict())
    else:
        found = answer(engine, a)
        for row in found.toLocalIterator() if a.limit is None else found.take(a.limit):
            print(*row, sep="\t")


if __name__ == "__main__":
    main()
