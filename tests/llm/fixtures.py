"""Small documents with what the operators must bear: nulls, empty and long texts, copies, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "text string, ids string, fp int, spans string, block int, doc_id long, digest int, lang string, key string, label string"


def sample(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Über", "niño", "x", "日本", "a,b", "token", "Sea", "sea", "\x0b", "😀!", "é", "or", "wer"]
    text = lambda k: " ".join(rnd.choice(vocabulary) + str(rnd.randint(0, 9)) for _ in range(k))
    passage = text(60)
    rows = [(i, text(rnd.randint(1, 90))) for i in range(0, n * 3, 3)]
    rows += [(1000 + i, f"{text(5)} {passage} {text(7)}") for i in range(8)]
    rows += [(2000 + i, rows[i][1].replace(" ", "  ", 1)) for i in range(5)] + [(2100 + i, rows[i][1] + " more") for i in range(5)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "12 34 !"), (3004, passage * 40), (3005, "a" * 900 + " b"), (3006, None)]
    rows += [rows[0], rows[0], (None, "no id here"), (3007, rows[3][1].upper())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")


def clashing(spark, rows):
    return spark.createDataFrame([(t, "x", 1, "y", 2, i, 3, "en", "k", "l") for i, t in rows], CLASHING)
