"""Rows with every awkward case, and the small tables as Python values."""

from __future__ import annotations

import os

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"

LONG = "long text, word by word. " * 20_000

EDGE_TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "The same text twice.",
    "The same text twice.",
    "12 345 --- !!",
    "<|im_start|>x<|im_end|> <\\| <|endoftext|> it's I'LL 'tis we've",
    "é" * 500 + "\u00a0ß\u2003ñ\u3000中文 \U0001f642 e\u0301 a\u0301,b",
    "Licensed under CC-BY 4.0. All rights reserved.",
    LONG,
]


def edge_docs(spark, texts=EDGE_TEXTS):
    """Ids with a null and a repeat; columns named like the operators' own results."""
    rows = [
        (None if i == 1 else min(i, 9), t, "en" if i % 2 else None, 5, "x", 0.5)
        for i, t in enumerate(texts)
    ]
    schema = "doc_id long, text string, lang string, ids int, labels string, score double"
    return spark.createDataFrame(rows, schema)


def empty_docs(spark):
    return edge_docs(spark, []).limit(0)


def small(name: str, *columns: str, data_dir: str = SMALL) -> list[tuple]:
    table = pq.read_table(os.path.join(data_dir, f"{name}.parquet"), columns=list(columns))
    return list(zip(*(table.column(c).to_pylist() for c in columns), strict=True))
