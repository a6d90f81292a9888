"""Unique names against a plain reading of the rule."""

import random
import time

from pagelens.operators import curate


def plain(names):
    taken, out = set(), []
    for base in names:
        dot = base.rfind(".")
        stem, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
        new, n = base, 1
        while new in taken:
            new, n = f"{stem} ({n}){ext}", n + 1
        taken.add(new)
        out.append(new)
    return out


def test_unique_names_as_one_by_one(spark):
    r = random.Random(5)
    parts = ["a", "a (1)", "a (2)", "a (1) (1)", ".png", " (1)", "", "a\n", "a (01)", "a (1).b", "v1.2 x", "a (3)"]
    items = []
    for i in range(900):
        items.append((f"f{i % 3}", r.choice(parts) + r.choice(["", ".png", ".png (1)", " (1).png", " (2)"]), i))
    want = {}
    for f in ("f0", "f1", "f2"):
        mine = [x for x in items if x[0] == f]
        want.update(zip((x[2] for x in mine), plain([x[1] for x in mine]), strict=True))
    df = spark.createDataFrame([*items, ("f0", None, 900), (None, "a", 901)], "folder string, name string, pos int")
    got = {x.pos: x.unique_name for x in curate.unique_names(df, "folder", "name", "pos").collect()}
    assert got == {**want, 900: None, 901: "a"}


def test_many_repeats_take_time_in_proportion(spark):
    names = curate._Names()
    began = time.process_time()
    out = [names.give("a.png") for _ in range(60_000)]
    # number by number from 1 for each, this took minutes
    assert len(set(out)) == 60_000 and out[-1] == "a (59999).png" and time.process_time() - began < 10
