"""``python -m stratum.cli``: search, cluster, place-clusters and place over a folder of Parquet tables."""

from __future__ import annotations

import argparse

from stratum.facade import TextCorpus, check_limit
from stratum.session import build_session
from stratum.sources.config import resolve_source

TABLES = ("passage", "corpus", "entity", "mention", "node", "translation", "entity_reading", "char_simplified", "variant_member")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratum")
    p.add_argument("--db", help="folder with one Parquet table for each name")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "search-ko", "search-reading", "hybrid", "variants", "cluster", "place-clusters", "place"):
        c = sub.add_parser(name)
        c.add_argument("term")
        c.add_argument("--limit", type=int, default=20)
        c.add_argument("--corpus")
        c.add_argument("--scope", choices=("article", "paragraph"), default="article")
        c.add_argument("--type")
        c.add_argument("--auto", action="store_true")
    return p


def main(argv: list[str] | None = None, env: str | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    root = resolve_source(a.db, env, "./tables")
    found = {}
    for t in TABLES:
        try:
            found[t] = spark.read.parquet(f"{root}/{t}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    c, n = TextCorpus(spark, found), check_limit(a.limit)
    run = {
        "search": lambda: c.search_han(a.term, n, a.corpus), "search-ko": lambda: c.search_ko(a.term, n), "search-reading": lambda: c.search_by_reading(a.term, n, a.corpus)[1],
        "hybrid": lambda: c.search_hybrid(a.term, n, corpus=a.corpus)[0], "variants": lambda: c.with_variants(a.term, n, a.corpus), "cluster": lambda: c.cluster(a.term, a.scope, a.type, limit=n),
        "place-clusters": lambda: c.place_clusters(a.term, a.scope, a.type or "지명", "auto" if a.auto else "fixed")["members"], "place": lambda: c.lookup_place(a.term, a.type, n),
    }
    run[a.command]().show(n, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
