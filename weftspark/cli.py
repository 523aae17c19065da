"""python -m weftspark.cli count N | http N --url URL | shell"""

from __future__ import annotations

import argparse
import time

from weftspark.plans import jobs
from weftspark.session import session
from weftspark.sources.readers import random_ints


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftspark")
    parser.add_argument("--master", help="Spark master; spark-submit's own if left out")
    modes = parser.add_subparsers(dest="mode", required=True)
    count = modes.add_parser("count", help="most popular of N random numbers modulo 100")
    http = modes.add_parser("http", help="sum of N echoed digits modulo 10000")
    for mode in (count, http):
        mode.add_argument("n", type=int)
        mode.add_argument("--seed", type=int, default=0)
    http.add_argument("--url", help="echo service; stubs beside the tasks if left out")
    http.add_argument("--max-in-flight", type=int, default=64)
    modes.add_parser("shell", help="interactive shell with spark, lines and objects")
    args = parser.parse_args(argv)
    if args.mode == "shell":
        from weftspark.shell import run

        run(args.master)
        return 0
    spark = session(args.master)
    began = time.time()
    if args.mode == "count":
        key, n = jobs.count_job(spark, args.n, args.seed)
        print(f"most popular is {key} with {n} times")
    else:
        print(jobs.http_job(spark, random_ints(spark, args.n, seed=args.seed), args.url, args.max_in_flight))
    print(f"completed in {1000 * (time.time() - began):.0f} ms")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
