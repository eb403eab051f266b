"""Small inputs with the awkward rows: nulls, empty and long texts, ties, repeated rows, names that clash."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{min(int(r.paretovariate(0.6)), vocabulary)}{r.choice(['', '', '.', ','])}" for _ in range(n)]


def texts(seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    base = [" ".join(words(seed * 100 + k, r.randint(3, 120))) for k in range(60)]
    out: list[str | None] = [None, "", " \n\t ", "one", "one two", "a b c"]
    out += base
    out += base[:8] + base[:3]  # exact copies
    for k in range(8):  # near copies
        w = base[10 + k].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    shared = " ".join(words(9999, 30))
    out += [base[k] + "\n" + shared + "\n" + base[k + 1] for k in range(30, 40)]
    out.append(" ".join(words(77, 20_000)))  # very long
    out.append("Été  été x " * 30)
    return out


def docs(spark, rows=None):
    rows = [(k, t) for k, t in enumerate(texts())] if rows is None else rows
    full = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The same rows with columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = "key words at word block row fp component hub shard cell piece length score label h _h _b kept count n_words n_removed step hits start"
    return df.withColumns({c: F.lit("clash") for c in names.split()})


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
