"""python -m quillmill FILE, or through spark-submit: parse one file and print its folder."""

import argparse

from quillmill.api import parse_document
from quillmill.plans.routing import ENGINES, TIERS


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillmill", description="Parse a document into blocks and chunks.")
    parser.add_argument("file")
    parser.add_argument("--engine", choices=["auto", *ENGINES], default="auto")
    parser.add_argument("--output-dir", default="outputs")
    parser.add_argument("--tier", choices=TIERS)
    got = parser.parse_args(args)
    options = {} if got.tier is None else {"tier": got.tier}
    print(parse_document(got.file, engine=got.engine, output_dir=got.output_dir, **options).output_dir)


if __name__ == "__main__":
    main()
