"""Small inputs that all operator tests share."""
from pyspark.sql import functions as F

WORDS = ("the quick brown fox jumps over a lazy dog while seven green birds sing old songs near quiet river banks "
         "and children run across wide open fields under warm summer light").split()


def prose(seed: int, n: int) -> str:
    """n words, different for each seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"{WORDS[x >> 16 & 31 if (x >> 16 & 31) < len(WORDS) else 0]}{x >> 8 & 63}")
    return " ".join(out)


def odd_documents(spark):
    """Nulls, empty, blank, long and repeated texts, and columns whose names clash with common internal ones."""
    long_text = "\n".join(prose(s, 12) for s in range(400, 700))
    rows = [(0, prose(0, 80)), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, prose(0, 80)), (6, long_text),
            (7, "é ß 中文 " * 40), (8, "a" * 500), (9, prose(9, 60)), (9, prose(9, 60)), (None, prose(0, 80)), (10, "\x00\x1c x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                     F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                     *[F.lit(k).alias(c) for k, c in enumerate(["id", "h", "pos", "n", "k", "length", "piece", "cls", "comp", "b"])])


def no_documents(spark):
    return odd_documents(spark).limit(0)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
