"""Commands: build, query, ask, search, status, review."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from loomgraph import progress as pg
from loomgraph.answer import Answer, ColdStartError, Session
from loomgraph.build import BuildResult, compile_base, replay
from loomgraph.config import Settings
from loomgraph.extract.clients import EmbedderError
from loomgraph.functions.text import elapsed
from loomgraph.logs import setup_logging
from loomgraph.session import clean
from loomgraph.snapshot import Store, review_lines
from loomgraph.streaming.watch import Watch

_MARK = {"ok": "✓", "run": "▶", "pending": "·"}


def summary(r: BuildResult) -> str:
    always = f"added {r.added}, modified {r.modified}, deleted {r.deleted}"
    return ", ".join([always, *(f"{n} {v}" for n, v in (("extracted", r.extracted), ("cached", r.cached), ("skipped", r.skipped), ("fallback descriptions", r.fallbacks)) if v)])


def _show(answer: Answer) -> None:
    print(answer.text)
    for source in dict.fromkeys(answer.citations):
        print(f"  source: {source}")
    if answer.review_flagged:
        print("  flagged for review")


def status(spark: SparkSession, s: Settings) -> list[str]:
    """Lines for a running, interrupted, dead, compiled or empty base."""
    store = Store(spark, s.out_dir)
    state = pg.read_progress(store)
    if state:
        alive = pg.check_alive_shown(store, pg.TerminalProgressReporter())
        head = "interrupted" if state["stage"] == "interrupted" else "running" if alive else "dead: its process has ended"
        lines = [f"{head} since {state['started_at']}"]
        for stage in pg.STAGES[:6]:
            how, percent = pg.stage_state(state, stage)
            lines.append(f"{_MARK[how]} {stage}" + (f" {percent}%" if percent is not None else ""))
        return lines
    if not store.version:
        return ["empty: nothing has been built"]
    counts = Session(spark, s).counts()
    return [f"compiled, version {store.version}", *(f"{k}: {v}" for k, v in counts.items()), f"documents: {store.read('manifest').count()}"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    top = argparse.ArgumentParser(prog="loomgraph")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    for flag in ("--watch", "--force", "--replay"):
        build.add_argument(flag, action="store_true")
    for name in ("query", "ask", "search"):
        sub.add_parser(name).add_argument("question")
    sub.choices["search"].add_argument("--community", action="store_true")
    sub.add_parser("status")
    sub.add_parser("review").add_argument("--clear", action="store_true")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    s = settings or Settings.from_env()
    setup_logging(s.out_dir if "://" not in s.out_dir else None)
    try:
        if args.command == "build":
            began = time.time()
            if args.replay:
                try:
                    print(summary(replay(spark, s)))
                except ValueError as e:
                    print(e, file=sys.stderr)
                    return 3
                return 0
            print(summary(compile_base(spark, s, force=args.force)), f"({elapsed(time.time() - began)})")
            if args.watch:
                watch = Watch(spark, s.raw_dir, lambda paths: print(len(paths), "changed:", summary(compile_base(spark, s))))
                watch.start().awaitTermination()
        elif args.command in ("query", "ask"):
            _show(Session(spark, s, reporter=pg.TerminalProgressReporter()).answer(args.question, args.command))
        elif args.command == "search":
            for r in Session(spark, s).search(args.question).orderBy("pos").collect():
                print(f"{r['score']:.2f} {r['community_summary']}")
        elif args.command == "status":
            print("\n".join(status(spark, s)))
        else:
            store = Store(spark, s.out_dir)
            if args.clear:
                store.clear_review()
            for r in review_lines(store.pending()).collect():
                print(r["value"])
    except ColdStartError as e:
        print(e, file=sys.stderr)
        return 1
    except EmbedderError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    finally:
        clean(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
