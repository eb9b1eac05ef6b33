"""Frames with the awkward rows that every operator has to take."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))


def rows():
    passage = " ".join(f"passage{i}" for i in range(60))
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "b", 10),
        (3, "Alpha  beta gamma delta epsilon zeta eta theta iota kappa lambda mu!", None, None, None),
        (4, f"first line of four\n{passage}\n\nlast line", "en", "a", 10),
        (5, f"another start here\n{passage}\nOf.\nquite another end", "de", "é", 10),
        (6, None, None, None, None),
        (7, "", "en", "a", 0),
        (8, " \t\n ", "en", "b", 4),
        (9, LONG, "en", "a", len(LONG)),
        (10, "é ß 漢字 🙂 ñ", "fr", "c", 11),
        (None, "no id at all but some words in a row of text here", "en", "a", 3),
        (None, None, None, None, None),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 10),
    ]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """Extra columns named like those that operators add or join by."""
    from pyspark.sql import functions as F

    names = ["size", "copy", "mix", "doc", "digest", "score", "predicted", "removed", "lines", "hit", "kept", "key", "id",
             "member", "block", "target", "n_hit", "label", "node", "rep"]
    return df.select("*", *[F.lit(7).alias(n) for n in names])
