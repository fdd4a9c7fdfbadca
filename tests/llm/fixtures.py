"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, sig string, score string, rep int, a int, b int, "
    "mention string, kind int, features string, part int, shard int, digest string, n int"
)
EXTRA = ("x", "y", 1, 2, 3, "m", 4, "f", 5, 6, "d", 7)


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(["ba", "re", "to", "li", "mu", "ska", "en"]) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(words(99, 6000))
    base = words(1, 200)
    near = [*base[:90], "other", *base[91:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"),
        (8, "ONE  Two"), (9, long), (10, long + " end"), (11, "x\x00y ퟿ é ü 日本語 😀"), (12, "12 34 !!"), (13, " ".join(words(2, 50))),
        (13, " ".join(words(2, 50))), (14, " ".join(words(3, 40))), (14, " ".join(words(4, 40))), (None, " ".join(base)), (None, None),
        (15, "mail me at Jo.Doe@Example.com or +1 (017) 555-7713 now"), (16, "jo.doe@example.com, 97.51.17.173, 4417744280351547."),
    ]
    return rows + [(100 + k, " ".join(words(k % 40, 30 + k % 40))) for k in range(120)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or ""), *EXTRA) for k, (i, t) in enumerate(rows)], DOCUMENTS
    )
