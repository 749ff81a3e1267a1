"""Command line: estimate, build, import-vectors, pack, compare, evaluate, search, encoders."""

from __future__ import annotations

import argparse
import json
import sys

from vantle.functions.vectors import PACKINGS


def _encoder_flags(parser: argparse.ArgumentParser) -> None:
    """Flags default to None, so that a file's settings stand between the defaults and what is given."""
    parser.add_argument("--config", help="file with the sections encoder and build")
    for name in ("--encoder", "--model", "--revision", "--cache-dir", "--device", "--pooling"):
        parser.add_argument(name)
    parser.add_argument("--local-files-only", action="store_true", default=None)
    parser.add_argument("--precision", choices=("auto", "float16", "float32"))
    parser.add_argument("--image-size", type=int)
    parser.add_argument("--image-mean", nargs="+", type=float)
    parser.add_argument("--image-std", nargs="+", type=float)


_ENCODER = ("model", "revision", "cache_dir", "local_files_only", "device", "precision", "pooling", "image_size", "image_mean", "image_std")
_BUILD = {"storage_dtype": str, "frame_rate": float, "max_frames": int, "frame_batch_size": int, "video_batch_size": int, "decode_workers": int}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vantle")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, what: commands.add_parser(name, help=what)
    estimate = add("estimate", "sizes of vectors, or what a budget holds")
    estimate.add_argument("--counts", nargs="+", type=int, default=[1000, 2000])
    estimate.add_argument("--dimension", type=int, default=512)
    estimate.add_argument("--dtype", choices=PACKINGS[:2], default="float32")
    estimate.add_argument("--budget")
    estimate.add_argument("--db", help="store whose listing and manifest tell what an item takes besides its vector")
    build = add("build", "a store from a folder of videos")
    build.add_argument("--videos-dir", required=True)
    build.add_argument("--output-dir", required=True)
    build.add_argument("--split-csv")
    build.add_argument("--id-column", default="video_id")
    build.add_argument("--limit", type=int, default=2000)
    for name, kind in _BUILD.items():
        build.add_argument("--" + name.replace("_", "-"), type=kind)
    for flag in ("--overwrite", "--resume", "--strict"):
        build.add_argument(flag, action="store_true")
    _encoder_flags(build)
    bring = add("import-vectors", "a store from a matrix and a split")
    bring.add_argument("--vectors", required=True)
    bring.add_argument("--output-dir", required=True)
    bring.add_argument("--split-csv")
    bring.add_argument("--id-column", default="video_id")
    bring.add_argument("--caption-column", default="sentence")
    bring.add_argument("--videos-dir")
    bring.add_argument("--model", default="")
    bring.add_argument("--source", default="")
    bring.add_argument("--normalize", action="store_true")
    bring.add_argument("--overwrite", action="store_true")
    pack = add("pack", "a store in another packing")
    pack.add_argument("--db", required=True)
    pack.add_argument("--output-dir", required=True)
    pack.add_argument("--packing", choices=PACKINGS, required=True)
    pack.add_argument("--overwrite", action="store_true")
    compare = add("compare", "what each packing costs")
    compare.add_argument("--db", required=True)
    compare.add_argument("--top-k", type=int, default=10)
    evaluate = add("evaluate", "retrieval of items by text vectors")
    evaluate.add_argument("--db", required=True)
    evaluate.add_argument("--text-vectors", required=True)
    evaluate.add_argument("--recall-at", nargs="+", type=int, default=[1, 5, 10])
    find = add("search", "items nearest to a text")
    find.add_argument("--db", required=True)
    find.add_argument("--query", required=True)
    find.add_argument("--top-k", type=int, default=10)
    _encoder_flags(find)
    encoders = add("encoders", "what is registered")
    encoders.add_argument("--json", action="store_true")
    return parser


def _given(args: argparse.Namespace) -> dict:
    return {"name": args.encoder, **{k: getattr(args, k) for k in _ENCODER}}


def _estimate(spark, args):
    from pyspark.sql import functions as F

    from vantle.functions import sizes
    from vantle.operators.store import Store

    if not args.budget:
        counts = spark.createDataFrame([(n,) for n in args.counts], "count long")
        return [r.asDict() for r in sizes.estimated(counts, args.dimension, args.dtype).collect()]
    overhead = Store(spark, args.db).metadata_bytes()["bytes_per_item"] if args.db else 0.0
    budget = spark.range(1).select(sizes.checked_budget(F.lit(args.budget)).alias("b")).select("b", sizes.readable(F.col("b")).alias("human")).first()
    packings = spark.createDataFrame([(p,) for p in PACKINGS], "packing string")
    rows = sizes.capacity_report(packings, F.lit(budget["b"]), F.lit(overhead), args.dimension).collect()
    return {"budget_bytes": budget["b"], "budget_human": budget["human"], "dimension": args.dimension, "metadata_bytes_per_item": overhead, "packings": [r.asDict() for r in rows]}


def _build(spark, args):
    from vantle.operators.build import build
    from vantle.operators.config import build_config

    config = build_config(args.config, _given(args), {k: getattr(args, k) for k in _BUILD})
    tell = lambda done: print(json.dumps(done), file=sys.stderr)
    return build(spark, args.videos_dir, args.output_dir, config, args.split_csv, args.id_column, args.limit, args.overwrite, args.resume, args.strict, progress=tell)


def _import(spark, args):
    from pyspark.sql import functions as F

    from vantle.operators.store import Store
    from vantle.sources import captions, npy

    npy.register(spark)
    rows = spark.read.format("npy").load(args.vectors)
    if args.split_csv:
        split = captions.read_split(spark, args.split_csv, args.id_column, args.caption_column)
        if split.count() != rows.count():
            raise SystemExit(f"the split has {split.count()} ids, the matrix has {rows.count()} rows")
        rows = rows.join(split, "row_index")
    else:
        rows = rows.select("row_index", F.concat(F.lit("row"), "row_index").alias("video_id"), F.lit(None).cast("string").alias("caption"), "embedding")
    if args.videos_dir:
        rows = captions.resolved(rows, args.videos_dir, captions.files_below(spark, args.videos_dir))
    config = {"encoder": {"model": args.model}} if args.model else {}
    return Store(spark, args.output_dir).import_vectors(rows, args.normalize, args.overwrite, source=args.source or args.vectors, config=config)


def _search(spark, args):
    from vantle.operators.config import encoder_config, encoder_of, config_file
    from vantle.operators.encoders import create_encoder
    from vantle.operators.store import Store

    store = Store(spark, args.db)
    own = encoder_config(config_file(args.config).get("encoder", {}) if args.config else {}, encoder_of(store.manifest()))
    encoder = create_encoder(encoder_config(_given(args), own))
    if not hasattr(encoder, "embed_texts"):
        raise SystemExit("this encoder takes no texts")
    return [r.asDict() for r in store.search([float(x) for x in encoder.embed_texts([args.query])[0]], args.top_k).collect()]


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "encoders":
        from vantle.operators.encoders import available

        found = available()
        print(json.dumps(found) if args.json else "\n".join(f"{k}: {', '.join(v)}" for k, v in found.items()))
        return 0
    from vantle.operators.store import Store
    from vantle.session import build_session
    from vantle.sources.captions import text_vectors

    spark = build_session()
    if args.command == "pack":
        out = Store(spark, args.db).pack(args.output_dir, args.packing, args.overwrite)
        vectors = out.bytes_of("vectors")
        found = {"output_dir": out.path, "packing": args.packing, "count": out.manifest()["count"], "database_bytes": out.bytes_of(), "vector_bytes": vectors}
    elif args.command == "compare":
        found = Store(spark, args.db).compare(args.top_k)
    elif args.command == "evaluate":
        store = Store(spark, args.db)
        texts = text_vectors(spark, args.text_vectors, store.manifest()["embedding_dim"])
        found = {"text_vectors": args.text_vectors, **store.evaluate(texts, tuple(args.recall_at))}
    else:
        found = {"estimate": _estimate, "build": _build, "import-vectors": _import, "search": _search}[args.command](spark, args)
    print(json.dumps(found, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
