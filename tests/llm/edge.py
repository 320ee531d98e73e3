"""Documents that every corpus operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "n", "k", "t", "key", "hash", "host", "ids", "redacted", "spans", "n_email", "m_copies", "q_kept", "component", "chunk", "edge", "low", "slots", "rule", "full_epochs", "bucket"]


def texts(seed: int = 1, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    words = ["the", "of", "Éa", "ing", "th", "schön", "que", "tion.", "and", "a@b.example", "+1 (555) 222-3333", "4111 1111 1111 1111", "10.0.0.1", "\n", "***", "x" * 50]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6, 30, 120]))) for _ in range(n)]
    out += out[:4] + [out[5] + " more", out[6][: len(out[6]) // 2]]
    return out


def documents(spark, seed: int = 1, clashing: bool = False):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts(seed))]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", "x", 4), (103, "word " * 30_000, "en", "src1", 150_000), (104, "中文 🙂 " * 40, "zh", "", 200)]
    rows += [(105, "tie tie", "en", "src1", 7)] * 2 + [(None, "no id at all here", "en", "src1", 17), (None, None, "en", "src1", None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("kept") for c in CLASHING})
    return df


def none(spark):
    return spark.createDataFrame([], COLUMNS)


def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, 0), (4, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
