"""Small tables for the operators' tests, and the plainest versions of what they compute."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


#: Nulls, empty texts, ties, repeated rows and signs of other scripts.
ODD = [(None, "a null id"), (1, None), (2, ""), (3, "   \t\n"), (4, "same"), (5, "same"), (6, "same"), (6, "same"), (7, "ünïcödé ⅓ 漢字 \x1c x"), (8, "one two three")]


def read(sf: str, name: str, *columns: str):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns) or None).to_pylist()
