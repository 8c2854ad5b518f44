"""python -m numera.cli: questions and archive upkeep from the command line, answers as key=value lines or JSON."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from numera.functions.integers import nth_prime_bound
from numera.operators import archive, maintenance, primality, proofs, selectors, sieve, stored
from numera.plans.segments import SEGMENT
from numera.sources import store
from numera.streaming import incremental


def _say(row: dict, as_json: bool) -> None:
    if as_json:
        print(json.dumps(row))
        return
    for k, v in row.items():
        if v is not None:
            print(f"{k}={str(v).lower() if isinstance(v, bool) else f'{v:.6f}' if isinstance(v, float) else v}")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="numera")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--timing", action="store_true", help="say how long it took")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("is-prime", "next-prime"):
        p = sub.add_parser(name)
        p.add_argument("n", nargs="?")
        p.add_argument("--file", help="a file with the number, white space ignored")
        p.add_argument("--archive", help="answer from an archive, or say that it does not cover the number")
        p.add_argument("--max-digits", type=int, default=primality.MAX_DIGITS)
        p.add_argument("--rounds", type=int, default=primality.ROUNDS, help="strong tests of a number without a small divisor")
        p.add_argument("--prove", action="store_true", help="look for a certificate")
        p.add_argument("--effort", type=int, default=proofs.EFFORT, help="steps of the search for one factor of a proof")
    p = sub.add_parser("count-first-n")
    p.add_argument("target", type=int)
    p.add_argument("--path", help="folder of state, progress and primes; without it nothing is kept")
    p.add_argument("--archive", help="an archive to continue from where it is ahead")
    p.add_argument("--resume", choices=("never", "auto", "always"), default="auto")
    p.add_argument("--segment", type=int, default=SEGMENT, help="numbers in a segment")
    p.add_argument("--checkpoint-every", type=int, default=256, help="segments in the first batch")
    p.add_argument("--checkpoint-seconds", type=float, help="seconds between commits")
    p = sub.add_parser("progress", help="the last progress row of a count")
    p.add_argument("path")
    p = sub.add_parser("build", help="write an archive of the first primes, or continue one")
    p.add_argument("archive")
    p.add_argument("target", type=int)
    p.add_argument("--chunk-primes", type=int, default=archive.CHUNK_PRIMES)
    p.add_argument("--exact", help="write exact chunks there as well")
    p = sub.add_parser("rebuild", help="make an archive from exact chunks")
    p.add_argument("exact")
    p.add_argument("archive")
    p.add_argument("--missing-only", action="store_true", help="encode only chunks that the archive lacks")
    p = sub.add_parser("repair", help="sieve lost chunks of an archive anew")
    p.add_argument("archive")
    p.add_argument("--exact", help="exact chunks that say what there should be")
    p.add_argument("--from-chunk", type=int)
    p.add_argument("--to-chunk", type=int)
    p.add_argument("--finalize-only", action="store_true", help="only count the index anew")
    p = sub.add_parser("status", help="what an archive and a count hold")
    p.add_argument("archive")
    p.add_argument("--path", help="folder of a count")
    p = sub.add_parser("memory-report")
    p.add_argument("--blocks", type=int, default=1_000_000)
    p.add_argument("--active", type=int, help="set bits in all blocks")
    return parser


def _answer(spark: SparkSession, args: argparse.Namespace) -> dict:
    text = store.read_big_integers(spark, args.file).first()["text"] if args.file else args.n
    numbers = spark.createDataFrame([(text,)], "text string")
    is_prime = args.command == "is-prime"
    if args.archive:
        keys = numbers.selectExpr("try_cast(text as bigint) as n")
        row = (stored.is_prime if is_prime else stored.next_prime)(keys, args.archive).first()
        return row.asDict() if row else {"status": "invalid"}
    if args.prove:
        prover = proofs.FactorProver(args.effort)
        found = primality.prove(numbers, prover) if is_prime else proofs.next_prime_proven(numbers, prover)
        row = proofs.verified(found, "text" if is_prime else "p").drop("wrong").first().asDict()
        if row["proven"]:
            row["status"] = "proven_prime"
    else:
        row = (primality.is_prime_big if is_prime else primality.next_prime_big)(numbers, max_digits=args.max_digits, rounds=args.rounds).first().asDict()
    shown = primality.preview(numbers["text"])
    return {**row, "text": numbers.select(shown).first()[0], "digits": len(text)}


def _count(spark: SparkSession, args: argparse.Namespace) -> dict:
    if not args.path:
        last = sieve.nth_prime(spark, args.target).first()
        return {"target": args.target, "last_prime": last["p"] if last else None}
    with incremental.stop_on_signals() as stop:
        done = incremental.first_n(spark, args.target, args.path, args.resume, args.segment, args.checkpoint_every, stop, args.archive, args.checkpoint_seconds, report=lambda row: print(json.dumps(row), file=sys.stderr))
    last = incremental.progress(spark, args.path).orderBy("version", ascending=False).first()
    told = {k: last[k] for k in ("percent", "eta")} if last else {}
    return {**done.first().asDict(), **told}


def _build(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Whole chunks that the archive has already are not written again."""
    chunks = archive.chunked(spark, nth_prime_bound(args.target), args.chunk_primes)
    last = (args.target - 1) // args.chunk_primes
    # the last chunk is cut at the target's prime
    chunks = chunks.where(chunks["p"] <= sieve.nth_prime(spark, args.target).first()["p"])
    seed = store.archive_seed(spark, args.archive)
    first = seed["found"] // args.chunk_primes if seed and seed["found"] % args.chunk_primes == 0 else 0
    if args.exact:
        store.write_exact(chunks, args.exact)
    wanted = chunks.where(chunks["chunk_id"] >= first)
    version = store.update_archive(wanted, args.archive) if first <= last and first else store.write_archive(chunks, args.archive) if not first else None
    return {"version": version, "first_chunk": first, "last_chunk": last, **store.archive_seed(spark, args.archive)}


def _status(spark: SparkSession, args: argparse.Namespace) -> dict:
    spans, head = store.read_index(spark, args.archive), spark.read.parquet(f"{args.archive}/manifest").orderBy("version", ascending=False).limit(1)
    empty = lambda names: spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    reports: DataFrame = empty(("found_count", "target_count", "archive_buffered_primes", "last_prime"))
    if args.path:
        state = incremental.load_state(spark, args.path)
        if state:
            reports = spark.createDataFrame([(state["found"], state["target"], None, state["last_prime"])], reports.schema)
    there = store.present_chunks(spark, args.archive)
    row = maintenance.status(reports, empty(("archive_committed_primes",)), head, there, spans, alive=False).first().asDict()
    gaps = maintenance.first_ranges(maintenance.islands(maintenance.missing(spans, there), "chunk_id")).first()
    size = store.folder_bytes(spark, args.archive).first()["bytes"]
    return {**row, "chunks": spans.count(), "missing": gaps["ranges"] or None, "more_missing": gaps["more"], "bytes": size, "gib": size / 2**30}


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "memory-report":
        row = {k: args.blocks * b for k, b in selectors.BYTES_PER_BLOCK.items()}
        if args.active is not None:
            row["sparse"] = (args.blocks + 1) * selectors.SPARSE_OFFSET_BYTES + args.active
        _say(row, args.json)
        return 0
    if args.command in ("is-prime", "next-prime") and (args.n is None) == (args.file is None):
        parser.error("exactly one of a number and --file")
    spark, began = SparkSession.builder.appName("numera").getOrCreate(), time.monotonic()
    if args.command in ("is-prime", "next-prime"):
        row = _answer(spark, args)
    elif args.command == "count-first-n":
        row = _count(spark, args)
    elif args.command == "progress":
        last = incremental.progress(spark, args.path).orderBy("version", ascending=False).first()
        row = last.asDict() if last else {"status": "no progress"}
    elif args.command == "build":
        row = _build(spark, args)
    elif args.command == "rebuild":
        row = {"chunks": store.backfill_archive(spark, args.exact, args.archive)} if args.missing_only else {"version": store.rebuild_archive(spark, args.exact, args.archive)}
    elif args.command == "repair":
        if args.finalize_only:
            row = {"version": store.reindex(spark, args.archive)}
        else:
            expected = archive.index(store.read_exact(spark, args.exact)) if args.exact else None
            row = {"repaired": store.repair(spark, args.archive, expected, args.from_chunk, args.to_chunk)}
    else:
        row = _status(spark, args)
    _say(row | ({"elapsed_seconds": time.monotonic() - began} if args.timing else {}), args.json)
    return 0 if row.get("error") is None and row.get("status") not in ("uncovered", "invalid", "no progress") else 1


if __name__ == "__main__":
    sys.exit(main())
