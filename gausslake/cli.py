"""Command line: align two splat files, merge several, or print the facts of one."""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import __version__
from .operators.register import merge, register
from .operators.transform import apply_transform, info
from .plans.quality import PRESETS
from .sources.ply import load_ply, save_ply


def _quality(text: str):
    """A preset, auto, or a share above 0 and at most 1."""
    try:
        value = float(text)
    except ValueError:
        if text in (*PRESETS, "auto"):
            return text
        raise argparse.ArgumentTypeError(f"{text!r} is no quality: one of {', '.join(PRESETS)}, auto, or a number") from None
    if not 0 < value <= 1:
        raise argparse.ArgumentTypeError(f"a quality must be above 0 and at most 1, not {text}")
    return value


def build_parser() -> argparse.ArgumentParser:
    """The arguments."""
    p = argparse.ArgumentParser(prog="gausslake", description=__doc__)
    p.add_argument("--version", action="version", version=f"gausslake {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("align", help="pose that takes SOURCE to TARGET")
    a.add_argument("target")
    a.add_argument("source")
    a.add_argument("--output", help="write the moved source here")
    m = sub.add_parser("merge", help="one splat of several, in the frame of one of them")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--output", required=True)
    m.add_argument("--ref", type=int, default=0, help="number of the input whose frame stays, from 0")
    m.add_argument("--no-dedupe", action="store_true")
    m.add_argument("--dedupe-method", choices=("voxel", "knn"), default="voxel")
    m.add_argument("--voxel", type=float)
    for s in (a, m):
        s.add_argument("--transform", choices=("se3", "sim3"), default="se3" if s is a else "sim3")
        s.add_argument("--init", default="fast" if s is a else "global")
        s.add_argument("--max-iters", type=int)
        s.add_argument("--quality", type=_quality, default="balanced")
    i = sub.add_parser("info", help="count, box, colours, opacities and scales of a splat")
    i.add_argument("input")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; errors of the input are told in one line and give 2."""
    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gausslake").getOrCreate()
    try:
        if args.command == "info":
            for k, v in info(load_ply(spark, args.input)).first().asDict().items():
                print(f"{k}: {v}")
            return 0
        if args.command == "align":
            source = load_ply(spark, args.source)
            r = register(load_ply(spark, args.target), source, init=args.init, transform=args.transform, max_iters=args.max_iters, quality=args.quality)
            print(np.array2string(r.T, precision=6, suppress_small=True))
            print(f"scale: {r.scale:.6f}\nconverged: {r.converged}")
            if "ambiguous" in r.info:
                print(f"ambiguous: {bool(r.info['ambiguous'])}")
            if args.output:
                save_ply(apply_transform(source, r.T), args.output)
            return 0
        if len(args.inputs) < 2:
            raise ValueError("merge needs two files and more")
        if not 0 <= args.ref < len(args.inputs):
            raise ValueError(f"--ref must be from 0 to {len(args.inputs) - 1}, not {args.ref}")
        out, _ = merge([load_ply(spark, f) for f in args.inputs], ref=args.ref, transform=args.transform, init=args.init, dedupe=not args.no_dedupe, dedupe_method=args.dedupe_method, voxel=args.voxel, max_iters=args.max_iters, quality=args.quality)
        print(f"rows: {save_ply(out, args.output)}")
        return 0
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {str(e).strip().splitlines()[-1]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
