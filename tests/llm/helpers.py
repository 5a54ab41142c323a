import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    """Random documents with exact copies, near copies, repeated lines, nulls, empty and long texts, and repeated rows."""
    rnd = random.Random(seed)
    vocab = {"en": ["the", "house", "stands", "near", "water", "and", "green", "hills", "with", "stones"], "de": ["der", "hund", "läuft", "über", "straße", "und", "schläft", "nicht", "größer", "baum"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        words = [rnd.choice(vocab[lang]) + rnd.choice(["", "", "s", "en", "x", "y"]) for _ in range(rnd.randint(60, 200))]
        text = "\n".join(" ".join(words[k : k + 15]) + "." for k in range(0, len(words), 15))
        rows.append([i, text, lang, f"src{i % 4}", len(text)])
    for i in range(6):
        rows[40 + i][1] = rows[1][1]
        w = rows[2][1].split(" ")
        w[10 * i] = "changed"
        rows[50 + i][1] = " ".join(w)
    rows[5][1], rows[6][1], rows[7][1], rows[8][1] = None, "", " \n\t ", "12 34 !!"
    rows[9][1] = "one two three"
    rows[10][1] = rows[10][1] * 40
    rows[11][2] = None
    rows[12][3] = None
    rows.append(list(rows[3]))
    return [tuple(r) for r in rows]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    """The documents with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", F.lit(1).alias("row"), F.lit("z").alias("host"), F.lit(2).alias("words"), F.lit(3).alias("key"), F.lit(4).alias("id"))


def empty(spark):
    return spark.createDataFrame([], DOCS)
