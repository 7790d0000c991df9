"""Small corpora for the tests of the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
#: names that the operators use inside
CLASHING = "t h n words spans score predicted bands chunk anchor part text_key lang_pred row item".split()


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty, blank, short and very long texts, copies, near copies, repeated ids and rows."""
    base, other = sentence(1, 80), sentence(2, 60)
    near = base.split()
    near[40] = "changed"
    lines = "\n".join(sentence(k, 14) for k in range(30, 36))
    edited = lines.replace(lines.split()[20], "edited", 1)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, other), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, "one"),
        (10, "two words"), (11, lines), (12, edited), (13, sentence(3, 10) + "\n" + other + "\n" + sentence(4, 10)),
        (14, " ".join(["again"] * 400)), (15, "é ü ñ 漢字 " * 90 + sentence(5, 30)), (16, sentence(6, 30_000)),
        (17, sentence(7, 40)), (17, sentence(7, 40)), (18, sentence(8, 40)), (18, sentence(9, 40)), (None, sentence(10, 40)), (None, None),
        (20, "\n\n" + lines + "\n\n"), (21, "tabs\tand\x0bother\x0cspace " + sentence(11, 40)), (22, "x" * 50_000),
    ]
    return rows + [(100 + k, " ".join(near[:60] + [f"tail{k}"] + near[61:])) for k in range(6)]


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], langs: list[str | None] | None = None) -> DataFrame:
    """The rows as documents with extra columns of clashing names, over a few partitions."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, x, langs[k] if langs else None, None, None, *(f"{c}{k}" for c in CLASHING)) for k, (i, x) in enumerate(rows)]
    return spark.createDataFrame(full, fields).repartition(4)


def small(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def pairs(df: DataFrame) -> list[tuple[int | None, str | None]]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(rows: list[tuple]) -> list[tuple]:
    """Rows in an order that allows null ids."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, [str(x) for x in r[1:]]))
