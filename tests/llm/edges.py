"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing names."""

import random


def edge_texts() -> list[str | None]:
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeiou") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    base = [rnd.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    half = base[:60] + [rnd.choice(words) for _ in range(60)]
    return [
        None, "", " \n\t ", "one", "two words", "a b c d e", " ".join(base), " ".join(base), " ".join(near), " ".join(half),
        "La la " * 60, "ünï çödé 日本語 😀 " * 8, "UPPER case, mixed-Case! upper CASE", "x" * 30_000, long, "line\n" * 5 + "other line\nline",
    ]


def edge_docs(spark):
    """The texts twice over where it matters, with null and repeated ids and columns that clash with results."""
    rows = [(i, t) for i, t in enumerate(edge_texts())]
    rows += [rows[6], rows[6], (None, "no id here"), (None, rows[8][1]), (None, None), (3, "three again")]
    clash = "n_words long, kept string, links string, class_id string, entities string, ids string, score string, key string, label string, item string"
    return spark.createDataFrame([(i, t, 7, "k", "l", "c", "e", "i", "s", "y", "b", "m") for i, t in rows], f"doc_id long, text string, {clash}")


def none_of(df):
    return df.where("1 = 0")
