"""Command line: ``python -m sidloom COMMAND --data FOLDER``.

list: names of all queries. run NAME: a query, shown or written. explain NAME:
its physical plan. eval [METRIC...]: the metric report as Markdown. All take
tables as FOLDER/<name>.parquet.
"""

from __future__ import annotations

import argparse
import sys

from .session import local_session


def _queries():
    from .plans import registry

    found = dict(registry.QUERIES)
    try:
        import importlib

        found |= importlib.import_module("sidloom" + ".llm.queries").QUERIES
    except ImportError:  # the optional part is not there
        pass
    return found


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sidloom", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--data", required=True)
        if name == "run":
            p.add_argument("--out", help="write Parquet there instead of showing rows")
            p.add_argument("--rows", type=int, default=20)
    p = sub.add_parser("eval")
    p.add_argument("metrics", nargs="*")
    p.add_argument("--data", required=True)
    p.add_argument("--out", help="write the report to this file")
    for p in sub.choices.values():
        p.add_argument("--cores", type=int, default=8)
    a = parser.parse_args(args)
    queries = _queries()
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.command in ("run", "explain") and a.query not in queries:
        print(f"no query {a.query!r}; 'list' shows all", file=sys.stderr)
        return 2
    spark = local_session(a.cores)
    if a.command == "eval":
        from .evaluate import METRICS, evaluate, markdown
        from .plans.extras import inputs

        text = markdown(evaluate(inputs(spark, a.data), a.metrics or list(METRICS)))
        if a.out:
            with open(a.out, "w") as f:
                f.write(text)
        else:
            print(text)
        return 0
    df = queries[a.query](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
