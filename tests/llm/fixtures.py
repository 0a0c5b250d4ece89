"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "the of and to in is that for on with as was by are this from at or an be".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) + str(rng.randrange(60)) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    base += [base[3], base[3], base[7] + " tail", "", "   \n\t ", "one", "One two three", "Ünïcödé ẖé ß İ Σας", "a\x0bb\x1cc d"]
    base += [prose(rng, 20_000), None, None]
    return base


def documents(spark, rows=None, seed: int = 1):
    rows = list(enumerate(texts(seed))) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):
    """Documents with null keys, repeated rows and columns whose names clash with the operators' own."""
    rows = [*enumerate(texts()), (None, "null key"), (None, "null key"), (None, None), (4, "tie b"), (4, "tie a"), (4, "tie a")]
    return spark.createDataFrame(
        [(i, t, 1, 2, "x", 0.5, 3, 4) for i, t in rows],
        "doc_id long, text string, bucket int, part int, fingerprint string, score double, component_id int, ids int",
    )


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
