"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, row int, at int, ids int, size int, set string"


def prose(r: random.Random, n: int) -> str:
    w = ["".join(r.choice("thei nare so é".replace(" ", "")) for _ in range(r.randint(2, 7))) for _ in range(60)]
    out = []
    for i in range(n):
        out.append(r.choice(w) + ("." if r.random() < 0.08 else "") + ("\n" if r.random() < 0.02 else ""))
    return " ".join(out)


def texts() -> list[str | None]:
    r = random.Random(5)
    own = [prose(r, r.randint(3, 260)) for _ in range(40)]
    near = own[3].split(" ")
    near[len(near) // 2] = "changed"
    passage = prose(r, 90)
    extra = [own[0], own[0], own[1], " ".join(near), None, "", "   \n\t", "one", "one", "two words", "a" * 70_000, "Der " * 3000]
    shared = [f"{prose(r, 40)}\n{passage}\n{prose(r, 30)}" for _ in range(4)]
    private = ["mail to ann.bee@mail.example.com now", "host 10.0.0.255 and 10.0.0.256", "card 4111 1111 1111 1111 ok", "call +1 (743) 555-3824 now a@b.c_x@y.zz"]
    licensed = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0. MIT-License", "the GNU General Public License, version 3"]
    return [*own, *extra, *shared, *private, *licensed]


@pytest.fixture(scope="session")
def rows():
    t = texts()
    out = [(i * 3, x, "en", ("b", "a", None)[i % 3], len(x or ""), 0.5, "s", i, i, i, i, "z") for i, x in enumerate(t)]
    return [*out, out[2], (None, t[5], None, "a", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
