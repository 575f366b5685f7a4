import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "é", "Zo") for b in ("r", "st", "ng", "lt", "", "ü")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", "\n", "", "", "", ",\t"])) for _ in range(n))


def small_documents():
    """Nulls, empty and long texts, exact and near copies, shared passages and lines, rows that repeat."""
    rng = random.Random(11)
    passage, line = prose(rng, 70).replace("\n", " "), "This line stands in many Documents"
    base = [rng.choice(WORDS) + str(k) for k in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, prose(rng, 8000)), (8, "x" * 5000), (9, "\n\n\n")]
    rows += [(k, prose(rng, rng.randint(5, 200))) for k in range(10, 40)]
    rows += [(k, f"{prose(rng, 30)}\n{line}\n{passage}\n  {line.upper()} \n{prose(rng, 30)}") for k in range(40, 60)]
    rows += [(k, rows[12][1]) for k in range(60, 80)]
    for k in range(80, 110):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(110, "Licensed under the Apache License, Version 2.0. MIT License; cc by cc BY-nc"), (111, "GNU GENERAL Public License"), (112, "<|endoftext|> a<|endoftext|>b  ünïcode 漢字 ՘ 😀 it's we'll  \n\n x"), (113, "RIFF GIF89a %PDF-1.4 PK\x03\x04 BM")]
    rows += [(115, "spam spam spam " * 40), (115, "spam spam spam " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs():
    return small_documents()


@pytest.fixture(scope="session")
def frame(spark, docs):
    """With columns whose names the operators use inside."""
    rows = [(i, t, f"l{k}", k, "r", -k) for k, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, rest string, chunk int, bucket string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(frame):
    return frame.where("doc_id < -1")


@pytest.fixture(scope="session")
def no_ids(spark):
    """Null ids beside others with the same texts."""
    text = " ".join(f"word{k}" for k in range(80))
    return spark.createDataFrame([(None, text), (None, text), (5, text), (6, None), (None, None)], "doc_id long, text string")
