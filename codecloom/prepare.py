"""Prepare a corpus from a configuration file.

    python -m codecloom.prepare corpus.json /data/corpus --tokenizer-file tokenizer.json

With `spark-submit`, pass this file and the same arguments. The tokenizer is one of a tokenizer file, a
factory `module:function` as `batch_tokenizer` takes it, or a stored vocabulary (word, token_id).
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from codecloom.config import CorpusConfig
from codecloom.layout import TokenLayout
from codecloom.operators.tokens import WordTokenizer, batch_tokenizer
from codecloom.plans.corpus import run_preparation
from codecloom.sources.store import ROWS_PER_FILE, open_counts


def file_factory(path: str, layout: TokenLayout) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A factory from a tokenizer file. The file is read here and travels with the tasks."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = file.read()
    size = Tokenizer.from_str(content).get_vocab_size()
    if size > layout.text_vocab_size:
        raise ValueError(f"the tokenizer has {size} ids, the layout holds {layout.text_vocab_size} text ids")

    def factory():
        tokenizer = Tokenizer.from_str(content)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return factory


def named_factory(name: str) -> Callable:
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name!r} is not of the form module:function")
    return getattr(importlib.import_module(module), function)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="codecloom.prepare", description="Prepare a training corpus.")
    parser.add_argument("config", help="configuration, JSON or YAML")
    parser.add_argument("output", help="folder of the corpus")
    tokenizer = parser.add_mutually_exclusive_group(required=True)
    tokenizer.add_argument("--tokenizer-file", help="tokenizer file (JSON)")
    tokenizer.add_argument("--tokenizer", help="factory of a tokenizer of lists of texts, module:function")
    tokenizer.add_argument("--vocabulary", help="stored table (word, token_id)")
    parser.add_argument("--stored-labels", action="store_true", help="store labels and masks, too")
    parser.add_argument("--rows-per-file", type=int, default=ROWS_PER_FILE)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run the preparation and print a line for each source; 1 if a source has fewer rows than its cap."""
    args = arguments(sys.argv[1:] if argv is None else argv)
    config = CorpusConfig.from_file(args.config)
    layout = TokenLayout()
    spark = spark or SparkSession.builder.appName("codecloom-prepare").getOrCreate()
    if args.vocabulary:
        tokenizer = WordTokenizer(spark.read.parquet(args.vocabulary), layout).column
    elif args.tokenizer:
        tokenizer = batch_tokenizer(named_factory(args.tokenizer))
    else:
        tokenizer = batch_tokenizer(file_factory(args.tokenizer_file, layout))
    run_preparation(
        spark, config, tokenizer, args.output, layout, args.stored_labels, rows_per_file=args.rows_per_file
    )
    counts = open_counts(spark, args.output).orderBy("source_ord").collect()
    for c in counts:
        short = f", fewer than its cap of {c['cap']}" if c["short_of_cap"] else ""
        print(f"{c['source']}: read {c['n_read']}, rejected {c['n_rejected']}, kept {c['n_kept']}{short}")
    print(f"total: {sum(c['n_kept'] for c in counts)} rows in {args.output}")
    return int(any(c["short_of_cap"] for c in counts))


if __name__ == "__main__":
    sys.exit(main())
