"""Lines that many documents share, against plain Python."""

import hashlib
import random
import string
from collections import defaultdict

from loanlag.llm import line_dedup
from tests.llm.helpers import EDGE, docs_of

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def want(rows, min_length, min_documents):
    key = lambda line: line.strip(line_dedup.WHITE).translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    # A null id is one document, smaller than any other.
    largest = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items()}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stays = [x for x in lines if len(key(x)) < min_length or len(holders[key(x)]) < min_documents or largest[key(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, min_length=40, min_documents=5):
    found = line_dedup.digests(line_dedup.drop_shared_lines(docs_of(spark, rows), min_length, min_documents))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_edge_rows(spark):
    shared = "  \t A line that five or more documents share, ÄÖ. \r"
    rows = EDGE + [(i, f"own {i}\n{shared}\n\n{shared.upper() if i % 2 else shared}\nend {i}") for i in range(100, 107)]
    rows += [(None, shared), (None, f"{shared}\nx"), (106, shared)]
    assert got(spark, rows) == want(rows, 40, 5)
    assert got(spark, rows, 1, 2) == want(rows, 1, 2)
    assert line_dedup.drop_shared_lines(docs_of(spark, []), 40, 5).count() == 0


def test_length_counts_code_points_and_thresholds_are_inclusive(spark):
    rows = [(i, f"{'é' * 40}\n{'é' * 39}") for i in range(5)] + [(i, "z" * 40) for i in range(10, 14)]
    assert got(spark, rows) == want(rows, 40, 5)
    assert sum(r[2] for r in got(spark, rows)) == 4


def test_random_lines(spark):
    rng = random.Random(12)
    lines = ["".join(rng.choice("abC ") for _ in range(3)) for _ in range(30)]
    rows = [(rng.choice([None, *range(25)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    assert got(spark, rows, 2, 3) == want(rows, 2, 3)


def test_a_hot_line_and_a_long_document(spark):
    hot = "the line that a third of all documents hold, word for word"
    rows = [(i, f"{hot}\nown {i}") for i in range(700)] + [(5000, "\n".join(f"{hot}\nline {k}" for k in range(3000)))]
    rows += [(5001, f"{hot}\nlast")]
    assert got(spark, rows) == want(rows, 40, 5)
